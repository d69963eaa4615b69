"""Dictionaries applied to texts and terms: expressions, lemmas, grammatical types, stop words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import key_ascii

#: Up to so many expressions are folded into one expression of replacements; longer dictionaries are applied in tasks, with the same result.
MOST_FOLDED = 60

# Apostrophes taken for one, and the letters that a plain letter of an entry stands for.
APOSTROPHES = "’`´ʼʹ"
ALIKE = {"a": "aàáâäãå", "e": "eèéêë", "i": "iìíîï", "o": "oòóôöõø", "u": "uùúûü", "y": "yÿ", "c": "cç", "n": "nñ"}


def expression_body(key: str) -> str:
    """A pattern for the entry: plain letters with their accents, œ also as oe, everything else as it is."""
    return "".join(f"[{ALIKE[c]}]" if c in ALIKE else "(?:œ|oe)" if c == "œ" else re.escape(c) if c.isascii() else c for c in key)


def expression_order(entries: dict[str, str]) -> list[tuple[str, str]]:
    """(entry, norm) in the order of use: longest first, of equally long ones as listed; both lower-cased and trimmed, blank ones dropped."""
    tidy = {}
    for key, norm in entries.items():
        key, norm = key.strip().lower().translate(str.maketrans(dict.fromkeys(APOSTROPHES, "'"))), norm.strip().lower()
        if key and norm:
            tidy.setdefault(key, norm)
    return sorted(tidy.items(), key=lambda e: -len(e[0]))


def apply_expressions(df: DataFrame, entries: dict[str, str], text_col: str = "text", most_folded: int = MOST_FOLDED) -> DataFrame:
    """Each multi-word entry replaced by its norm, longest first, each seeing what the one before made; `replaced` counts them.

    Apostrophes of the texts become plain ones. An entry stands between borders of words, in any case, with or without accents on its plain letters.
    """
    order = expression_order(entries)
    rows = df.withColumn(text_col, F.translate(text_col, APOSTROPHES, "'" * len(APOSTROPHES)))
    if len(order) > most_folded:
        return applied_in_tasks(rows, order, text_col)
    rows = rows.withColumn("replaced", F.when(F.col(text_col).isNotNull(), F.lit(0)))
    for key, norm in order:
        pattern = rf"(?iU)(?<![\p{{L}}\p{{N}}_]){expression_body(key)}(?![\p{{L}}\p{{N}}_])"
        rows = rows.withColumn("replaced", F.col("replaced") + F.regexp_count(text_col, F.lit(pattern)))
        rows = rows.withColumn(text_col, F.regexp_replace(text_col, pattern, norm.replace("\\", "\\\\").replace("$", "\\$")))
    return rows


def applied_in_tasks(df: DataFrame, order: list[tuple[str, str]], text_col: str) -> DataFrame:
    """The same for long dictionaries: an entry is looked for by its pattern only in texts that hold it once accents are off."""
    plain = str.maketrans({x: c for c, all_of in ALIKE.items() for x in all_of} | {"œ": "oe"})
    listed = [(key.translate(plain), rf"(?<!\w){expression_body(key)}(?!\w)", norm) for key, norm in order]

    @F.pandas_udf("replaced int, text string")
    def replaced(texts: pd.Series) -> pd.DataFrame:
        found: dict[str, re.Pattern] = {}
        out = []
        for text in texts:
            n, flat = 0, (text or "").lower().translate(plain)
            for key, body, norm in listed:
                if key in flat:
                    pattern = found.get(body) or found.setdefault(body, re.compile(body, re.IGNORECASE))
                    text, k = pattern.subn(lambda _, norm=norm: norm, text)
                    n, flat = n + k, text.lower().translate(plain) if k else flat
            out.append((None if text is None else n, text))
        return pd.DataFrame(out, columns=["replaced", "text"])

    rows = df.withColumn("_r", replaced(text_col))
    return rows.withColumns({"replaced": F.col("_r.replaced"), text_col: F.col("_r.text")}).drop("_r")


def merged_expressions(base: DataFrame, user: DataFrame) -> DataFrame:
    """Both dictionaries (dic_mot, dic_norm, dic_morpho); user entries that the base has are ignored, one row for each dic_mot."""
    tidy = lambda df: df.withColumn("dic_mot", F.translate(F.trim(F.lower("dic_mot")), "’ʼ", "''"))
    base, user = tidy(base), tidy(user)
    both = base.unionByName(user.join(base.select("dic_mot"), "dic_mot", "left_anti"))
    return both.groupBy("dic_mot").agg(F.min(F.struct("dic_norm", "dic_morpho")).alias("s")).select("dic_mot", "s.*")


def first_forms(lexicon: DataFrame) -> DataFrame:
    """One entry for each form of (c_mot, c_lemme, c_morpho), the least by lemma and type."""
    tidy = lexicon.select(*[F.trim(F.lower(c)).alias(c) for c in ("c_mot", "c_lemme", "c_morpho")])
    return tidy.groupBy("c_mot").agg(F.min(F.struct("c_lemme", "c_morpho")).alias("s")).select("c_mot", "s.*")


def lemmatised(tokens: DataFrame, lexicon: DataFrame, token_col: str = "token") -> DataFrame:
    """tokens with lemma: the lexicon's, else the token itself."""
    forms = first_forms(lexicon).select("c_mot", "c_lemme")
    return tokens.join(forms, tokens[token_col] == forms["c_mot"], "left").withColumn("lemma", F.coalesce("c_lemme", token_col)).drop("c_mot", "c_lemme")


def term_types(terms: DataFrame, lexicon: DataFrame, term_col: str = "term") -> DataFrame:
    """terms with type: the sorted types of the form, else of the lemma, joined by |."""
    joined = F.array_join(F.array_sort(F.collect_set("c_morpho")), "|")
    by_form = lexicon.groupBy(F.col("c_mot").alias("_f")).agg(joined.alias("_ft"))
    by_lemma = lexicon.groupBy(F.col("c_lemme").alias("_l")).agg(joined.alias("_lt"))
    out = terms.join(by_form, terms[term_col] == by_form["_f"], "left").join(by_lemma, terms[term_col] == by_lemma["_l"], "left")
    return out.withColumn("type", F.coalesce("_ft", "_lt")).drop("_f", "_ft", "_l", "_lt")


def expanded(terms: DataFrame, lexicon: DataFrame, term_col: str = "term") -> DataFrame:
    """term, also: each term with itself, the forms of which it is the lemma, and the lemmas of its form, compared by ASCII key."""
    keyed = terms.select(term_col, key_ascii(term_col).alias("k"))
    words = lexicon.select(key_ascii("c_mot").alias("m"), key_ascii("c_lemme").alias("l"), "c_mot", "c_lemme")
    forms = keyed.join(words, keyed["k"] == words["l"]).select(term_col, F.col("c_mot").alias("also"))
    lemmas = keyed.join(words, keyed["k"] == words["m"]).select(term_col, F.col("c_lemme").alias("also"))
    return terms.select(term_col, F.col(term_col).alias("also")).union(forms).union(lemmas).distinct()


def without_stop_words(tokens: DataFrame, stop: DataFrame, token_col: str = "token") -> DataFrame:
    return tokens.join(stop.select(F.col(stop.columns[0]).alias(token_col)), token_col, "left_anti")


def by_category(terms: DataFrame, lexicon: DataFrame, allowed: list[str], others: bool = False, without: list[str] = (), term_col: str = "term") -> DataFrame:
    """Terms whose form or lemma has an allowed category; with `others` also words that the lexicon lacks; never those in `without`."""
    good = lexicon.filter(F.col("c_morpho").isin(*allowed))
    known = good.select(F.col("c_mot").alias("_t")).union(good.select("c_lemme")).distinct()
    out = terms.join(known, terms[term_col] == known["_t"], "left_semi")
    if others:
        listed = lexicon.select(F.col("c_mot").alias("_t")).union(lexicon.select("c_lemme")).distinct()
        out = out.unionByName(terms.join(listed, terms[term_col] == listed["_t"], "left_anti").filter(F.col(term_col).rlike(r"[\p{L}\p{N}]")))
    return out.filter(~F.col(term_col).isin(*without)) if without else out


def norms(lexicon: DataFrame, connectors: DataFrame, key: str = "ortho") -> DataFrame:
    """column, mean, total over the numeric columns of the entries that are connectors."""
    keys = connectors.select(F.lower("key").alias("_k")).distinct()
    found = lexicon.join(keys, F.lower(lexicon[key]) == keys["_k"], "left_semi")
    numeric = [c for c, kind in lexicon.dtypes if kind in ("double", "float", "int", "bigint")]
    long = found.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], numeric, "column", "value")
    return long.groupBy("column").agg(F.avg("value").alias("mean"), F.sum("value").alias("total"))


def present_terms(text: Column, terms: list[str]) -> Column:
    """The distinct terms found in a text, in order; plural s or x allowed, blanks of any length."""
    found = [F.when(text.rlike(r"(?iU)(?<![\p{L}\p{N}_])" + r"\s+".join(rf"\Q{w}\E" for w in t.split()) + r"[sx]?(?![\p{L}\p{N}_])"), F.lit(t)) for t in sorted(terms)]
    return F.array_compact(F.array(*found))
