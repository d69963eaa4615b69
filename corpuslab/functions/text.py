"""Column functions on text: cleaning, words, dates, times, names. All are built-in expressions; (?U) makes \\w and \\b Unicode."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.column import Column as C

WORD = r"[\p{L}\p{N}_]+"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]"

# French months by number.
MONTHS_FR = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
MONTHS_EN = "january february march april may june july august september october november december".split()

ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def col(c: Column | str) -> Column:
    return c if isinstance(c, C) else F.col(c)


def extract_all(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))


def words(text: Column | str) -> Column:
    """Letter, digit and underscore runs."""
    return extract_all(text, WORD)


def words_lower(text: Column | str) -> Column:
    return words(F.lower(col(text)))


def words_flesch(text: Column | str) -> Column:
    return extract_all(F.lower(col(text)), r"[\p{L}\p{N}_']+")


def words_ngram(text: Column | str) -> Column:
    return extract_all(F.lower(col(text)), r"[\p{L}\p{N}_'-]+")


def words_jsd(text: Column | str, stop: list[str] = (), least: int = 1) -> Column:
    """Letters only, apostrophes part words; stop words and words under `least` letters go."""
    found = extract_all(F.translate(F.lower(col(text)), "'’", "  "), r"[a-zàâäáãåçéèêëíìîïñóòôöõúùûüýÿæœ]+")
    return F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*stop) if stop else F.length(w) >= least)


def words_lda(text: Column | str, stop: list[str] = ()) -> Column:
    """Pieces between blanks and apostrophes of the text's word characters; those of two or more letters."""
    good = extract_all(F.lower(col(text)), r"(?<![\p{L}\p{N}_])\p{L}{2,}+(?![\p{L}\p{N}_])")
    return F.filter(good, lambda w: ~w.isin(*stop)) if stop else good


def words_cooc(text: Column | str, pivot: str | None = None, numbers: bool = False, single: bool = False, stop: list[str] = ()) -> Column:
    """Words with the elision rule: what stands before the first apostrophe of a word goes. The pivot is always kept."""
    found = F.transform(extract_all(F.lower(col(text)), r"[\p{L}\p{N}'’]+"), lambda w: F.regexp_replace(w, r"^[^'’]*['’]", ""))

    def good(w: Column) -> Column:
        ok = w.rlike(r"^[\p{L}\p{N}]+$")
        if not numbers:
            ok = ok & ~w.rlike(r"^\p{N}+$")
        if not single:
            ok = ok & (F.length(w) > 1)
        if stop:
            ok = ok & ~w.isin(*stop)
        return ok | (w == pivot) if pivot else ok

    return F.filter(found, good)


def words_align(text: Column | str) -> Column:
    return extract_all(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}' ]", " "), r"[\p{L}0-9']+")


def clean(text: Column | str, digits: bool = True, elisions: bool = True, hyphens: bool = True, drop: str = r"[^\p{L}\p{N}' -]") -> Column:
    """No-break blanks, digits, hyphens, elisions, other characters, runs of blanks, in this order; lower case."""
    out = F.translate(F.lower(col(text)), "  ", "  ")
    if digits:
        out = F.regexp_replace(out, r"[0-9]+", " ")
    if hyphens:
        out = F.regexp_replace(out, "-", " ")
    if elisions:
        out = F.regexp_replace(out, r"(?iU)\b([cdjlmnst]|qu)['’](?=\p{L})", "")
    out = F.regexp_replace(out, drop, " ")
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def strip_meta(text: Column | str) -> Column:
    """Without the lines that begin with four stars."""
    out = F.regexp_replace(col(text), r"(?m)^[ \t]*\*{4}.*$\n?", "")
    return F.when(out != col(text), F.ltrim(out)).otherwise(col(text))


def strip_blank_lines(text: Column | str) -> Column:
    lines = F.split(F.regexp_replace(col(text), "\r\n?", "\n"), "\n")
    return F.array_join(F.filter(lines, lambda x: F.trim(x) != ""), "\n")


def strip_accents(text: Column | str) -> Column:
    return F.translate(col(text), ACCENTED, PLAIN)


def key_ascii(text: Column | str) -> Column:
    return F.regexp_replace(strip_accents(F.trim(F.lower(col(text)))), r"[^a-z0-9_]", "")


def trim_blanks(text: Column | str) -> Column:
    """Without the blanks at both ends, no-break and other wide ones too."""
    return F.regexp_replace(col(text), r"^\p{Zs}+|\p{Zs}+\z", "")


def strip_emoji(text: Column | str) -> Column:
    return trim_blanks(F.regexp_replace(col(text), f"{EMOJI}+", ""))


def join_hyphenated(text: Column | str) -> Column:
    """Soft hyphens go, words cut at line ends are joined, blanks and empty lines squeezed."""
    out = F.regexp_replace(col(text), "­", "")
    out = F.regexp_replace(out, r"-\n([^\s])", "$1")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.lower(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def drop_lines(text: Column | str, patterns: list[str]) -> Column:
    """Without the lines that one of the patterns matches in full: as they are, squeezed, without blanks, without accents, or both."""
    whole = "^(" + "|".join(patterns) + ")$"

    def hit(line: Column) -> Column:
        squeezed = F.trim(F.regexp_replace(line, r"[ \t]+", " "))
        tight = F.regexp_replace(line, r"[ \t]+", "")
        found = F.lit(False)
        for form in (line, squeezed, tight, strip_accents(line), strip_accents(tight)):
            found = found | form.rlike(whole)
        return found

    return F.array_join(F.filter(F.split(col(text), "\n"), lambda x: ~hit(x)), "\n")


def video_id(url: Column | str) -> Column:
    """The id of eleven characters of a video address; null if there is none."""
    forms = (r"youtu\.be/([A-Za-z0-9_-]{11})", r"[?&]v=([A-Za-z0-9_-]{11})", r"/(?:shorts|embed|live|v|videos)/([A-Za-z0-9_-]{11})")
    return F.coalesce(*[F.nullif(F.regexp_extract(col(url), p, 1), F.lit("")) for p in forms])


def date_fr(text: Column | str) -> Column:
    """"11 septembre 2024" or "September 11, 2024" as a date; null if it is neither."""
    low = F.lower(F.trim(col(text)))
    months = F.create_map(*[F.lit(x) for names in (MONTHS_FR, MONTHS_EN) for k, m in enumerate(names, 1) for x in (m, k)])
    french, english = r"^([0-9]{1,2}) (\p{L}+) ([0-9]{4})$", r"^(\p{L}+) ([0-9]{1,2}), ([0-9]{4})$"
    day = F.coalesce(F.nullif(F.regexp_extract(low, french, 1), F.lit("")), F.nullif(F.regexp_extract(low, english, 2), F.lit("")))
    month = F.coalesce(F.nullif(F.regexp_extract(low, french, 2), F.lit("")), F.nullif(F.regexp_extract(low, english, 1), F.lit("")))
    year = F.coalesce(F.nullif(F.regexp_extract(low, french, 3), F.lit("")), F.nullif(F.regexp_extract(low, english, 3), F.lit("")))
    return F.try_to_date(F.concat_ws("-", year, F.lpad(months[month].cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def date_iso(text: Column | str, form: str = "dd/MM/yyyy HH:mm") -> Column:
    """An ISO instant in another form; what is no instant stays."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.regexp_replace(col(text), "Z$", "+00:00")), form), col(text))


def seconds_of(text: Column | str) -> Column:
    """h:m:s[,fraction] or m:s as seconds; null otherwise."""
    parts = F.split(F.translate(F.trim(col(text)), ",", "."), ":")
    number = lambda x: x.try_cast("double")
    three = number(F.get(parts, F.lit(0))) * 3600 + number(F.get(parts, F.lit(1))) * 60 + number(F.get(parts, F.lit(2)))
    two = number(F.get(parts, F.lit(0))) * 60 + number(F.get(parts, F.lit(1)))
    return F.when(F.size(parts) == 3, three).when(F.size(parts) == 2, two).otherwise(number(F.get(parts, F.lit(0))))


def hms(seconds: Column | str) -> Column:
    s = F.floor(col(seconds))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))


def source_name(text: Column | str) -> Column:
    return F.concat(F.lit("*source_"), F.regexp_replace(F.trim(F.split(col(text), ",")[0]), "[ '’]+", "_"))


def variable_name(text: Column | str) -> Column:
    """A name fit for a corpus header."""
    out = F.regexp_replace(F.trim(col(text)), r"^\*+", "")
    out = F.regexp_replace(out, "=.*$", "")
    return F.regexp_replace(F.regexp_replace(out, "[,;:]+$", ""), " +", "-_")


def slug(text: Column | str) -> Column:
    out = F.regexp_replace(strip_accents(F.lower(col(text))), "[^a-z0-9]+", "-")
    return F.regexp_replace(out, "^-+|-+$", "")


def syllables(word: Column) -> Column:
    """Vowel groups of a French word's letters and hyphens, one less if it ends in e and has several, one at least; 0 without letters and hyphens."""
    kept = F.regexp_replace(F.lower(word), "[^a-zàâäéèêëîïôöùûüÿœç-]", "")
    groups = F.regexp_count(kept, F.lit("[aeiouyàâäéèêëîïôöùûüÿœ]+"))
    mute = kept.endswith("e") & (groups > 1)
    return F.when(kept == "", 0).otherwise(F.greatest(F.lit(1), groups - mute.cast("int")))


def escape_html(text: Column | str) -> Column:
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def alternation(terms: list[str]) -> str:
    """Longest first, quoted, between word borders."""
    quoted = [r"\Q" + t + r"\E" for t in sorted(terms, key=lambda t: (-len(t), t))]
    return r"(?iU)(?<![\p{L}\p{N}_])(" + "|".join(quoted) + r")(?![\p{L}\p{N}_])"


def highlight(text: Column | str, terms: list[str], tag: str = "span") -> Column:
    return F.regexp_replace(col(text), alternation(terms), f"<{tag}>$1</{tag}>")


def cut_at(text: Column | str, pattern: str) -> Column:
    """Array of (piece, mark): what stands before each match of the pattern, and the match; the last piece has no mark (null)."""
    both = rf"(?s)(.*?)(?:({pattern})|\z)"
    pieces, marks = (F.regexp_extract_all(col(text), F.lit(both), F.lit(k)) for k in (1, 2))
    found = F.arrays_zip(pieces.alias("piece"), F.transform(marks, lambda m: F.nullif(m, F.lit(""))).alias("mark"))
    # at the text's end the pattern matches nothing once more than there are marks, or twice
    last = F.coalesce(F.array_position(F.transform(found, lambda x: x["mark"].isNull()), F.lit(True)), F.lit(1)).cast("int")
    return F.slice(found, F.lit(1), F.greatest(F.lit(1), last))


def connector_pattern(keys: list[str], mode: str = "any_word") -> str:
    """Longest-first alternation of the keys, without flags.

    Word borders stand around a key: "edge_alnum" if its first and last character are letters or digits, "any_word" if it holds any,
    "always" in any case; "strip" trims keys first (so line ends vanish), then as "any_word". A line-end key also takes a carriage return.
    """
    if mode == "strip":
        keys = [k.strip() for k in keys if k.strip()]
    parts = []
    for key in sorted({k for k in keys if k}, key=lambda k: (-len(k), k)):
        body = r"\r?\n" if key in ("\n", "\r\n") else rf"\Q{key}\E"
        word = {"always": True, "edge_alnum": key[0].isalnum() and key[-1].isalnum()}.get(mode, any(c.isalnum() or c == "_" for c in key))
        parts.append(rf"\b{body}\b" if word else body)
    return "|".join(parts) or "(?!)"


def without_header_ends(text: Column | str) -> Column:
    """Text in which the ends of lines that begin with four stars are tabs, so that they count as no connector."""
    return F.regexp_replace(col(text), r"(?m)^(\*{4}[^\n]*?)\r?\n", "$1\t")


def annotate_html(text: Column | str, labels: dict[str, str]) -> Column:
    """Escaped text in which each connector stands in a span of its label's class, after its label.

    One pass over the escaped text, the longest key first, so that nothing is annotated within an annotation. A line end that is a key is shown
    as an arrow and followed by a break; after a line of four stars it is a break alone. Other line ends stay.
    """
    newline = next((v for k, v in labels.items() if k in ("\n", "\r\n")), None)
    keys = {k: v for k, v in labels.items() if k and k not in ("\n", "\r\n")}
    lower = {k.lower(): v for k, v in keys.items()}
    slugged = lambda label: re.sub("[^a-z0-9]+", "-", label.lower()).strip("-") or "label"

    def span(label: str) -> tuple[str, str]:
        return f'<span class="connector-annotation connector-{slugged(label)}"><span class="connector-label">{html.escape(label)}</span><span class="connector-text">', "</span></span>"

    def annotated(line: Column) -> Column:
        if not keys:
            return line
        opening = F.create_map(*[F.lit(x) for k, v in lower.items() for x in (k, span(v)[0])])
        marked = lambda x: F.concat(x["piece"], F.when(x["mark"].isNotNull(), F.concat(opening[F.lower(x["mark"])], html_text(x["mark"]), F.lit("</span></span>"))).otherwise(""))
        return F.array_join(F.transform(cut_at(line, "(?iU)" + connector_pattern(list(keys), "edge_alnum")), marked), "")

    html_text = escape_html
    escaped = F.coalesce(escape_html(text), F.lit(""))
    if newline is None:
        return F.replace(annotated(escaped), F.lit("\r\n"), F.lit("\n"))
    lines = F.split(F.replace(escaped, F.lit("\r\n"), F.lit("\n")), "\n")
    arrow = "↵".join(span(newline)) + "<br />"
    ended = lambda line, i: F.concat(annotated(line), F.when(i == F.size(lines) - 1, "").when(line.startswith("****"), "<br />").otherwise(arrow))
    return F.array_join(F.transform(lines, ended), "")


def french_punctuation(text: Column | str) -> Column:
    """No blanks before closing punctuation."""
    return F.regexp_replace(col(text), r" +([,.;:!?%)])", "$1")
