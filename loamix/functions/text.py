"""Text column functions. All return columns and stay in the JVM, but for the HTML and inflate functions at the end."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys of a Latin and of a Cyrillic keyboard, without and with shift.
LATIN_KEYS = "`qwertyuiop[]asdfghjkl;'zxcvbnm,./" + '~@#$%^&QWERTYUIOP{}ASDFGHJKL:"|ZXCVBNM<>?'
CYRILLIC_KEYS = "ёйцукенгшщзхъфывапролджэячсмитьбю." + 'Ё"№;%:?ЙЦУКЕНГШЩЗХЪФЫВАПРОЛДЖЭ/ЯЧСМИТЬБЮ,'


def _full(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def letters(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return _full(F.split(F.lower(text), r"[^\p{L}]+"))


def word_chars(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return _full(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))


def letters_or_digits(text: Column) -> Column:
    """Runs of decimal digits, or of letters and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{Nd}+|[\p{L}_]+"), F.lit(0))


def spaces(text: Column) -> Column:
    return _full(F.split(text, r"\s+"))


def _windows(text: Column, n: int) -> Column:
    """All runs of n characters. The text is cut into characters once; cutting each run out of it would take time by the square of its length."""
    runs = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0))), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))
    return F.get(F.transform(F.array(F.split(text, "")), runs), F.lit(0))


def char_ngrams(text: Column, n: int, pad: str = "$") -> Column:
    """Character n-grams with n - 1 pads on either side; an empty text has none."""
    padded = F.concat(F.lit(pad * (n - 1)), text, F.lit(pad * (n - 1)))
    return F.when(F.length(text) > 0, _windows(padded, n)).otherwise(F.array().cast("array<string>"))


def hash_trigrams(words: Column) -> Column:
    """Trigrams of #w1#w2#...#, without those that have # in the middle."""
    joined = F.concat(F.lit("#"), F.array_join(words, "#"), F.lit("#"))
    grams = F.filter(_windows(joined, 3), lambda g: F.substr(g, F.lit(2), F.lit(1)) != "#")
    return F.when(F.size(words) > 0, grams).otherwise(F.array().cast("array<string>"))


def normalised(tokenizer: Callable[[Column], Column], word: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """``tokenizer`` with each token replaced by ``word`` of it, such as a stem or a lemma; empty ones go."""
    return lambda text: _full(F.transform(tokenizer(text), word))


def light_stem(word: Column) -> Column:
    """Without one English inflection ending; other stemmers are passed to ``normalised`` in its place."""
    return F.regexp_replace(word, "(?:ing|ed|es|s)$", "")


def drop_numbers(words: Column) -> Column:
    """Without words that start with five digits."""
    return F.filter(words, lambda w: ~w.rlike(r"^\d{5}"))


def drop_stop_words(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(stop))


def host(url: Column) -> Column:
    """Host without a leading www.; null if the URL has none or is malformed."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    for pattern in ("^http://", "^https://", r"^www\.", "/$"):
        url = F.regexp_replace(url, pattern, "")
    return url


def absolute(href: Column, origin: Column) -> Column:
    """Site-relative links get the origin; empty ones are null."""
    return F.when(href.startswith("/"), F.concat(origin, href)).when(href != "", href)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def body_text(html: Column) -> Column:
    """Text without scripts, styles, titles, anchors and tags, by patterns; entities stay as they are."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|title|a)\b[^>]*>.*?</(script|style|title|a)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def fix_layout(text: Column) -> Column:
    """Words typed with a Latin layout, as the Cyrillic keys would give them; other texts are null."""
    return F.when(text.rlike(r"^[A-Za-z\[\];',.`{}:\"<>~ ]+$"), F.translate(text, LATIN_KEYS, CYRILLIC_KEYS))


def fixed_words(words: DataFrame, vocabulary: DataFrame, normalise: Callable[[Column], Column] = F.lower) -> DataFrame:
    """``words`` (word, ..) with ``fixed``: a word of Latin letters becomes what the Cyrillic keys give if that, normalised, is in ``vocabulary`` (term)."""
    other = F.when(F.col("word").rlike("^[a-zA-Z]+$"), F.translate("word", LATIN_KEYS, CYRILLIC_KEYS))
    known = vocabulary.select(F.col("term").alias("_term")).distinct()
    found = words.withColumn("_other", other).join(known, normalise(F.col("_other")) == F.col("_term"), "left")
    return found.select(*words.columns, F.when(F.col("_term").isNotNull(), F.col("_other")).otherwise(F.col("word")).alias("fixed"))


def clean_value(value: Column) -> Column:
    return F.regexp_replace(value, r"[\s|:]", "")


def sigmoid(x: Column, limit: float = 20.0) -> Column:
    return F.when(x > limit, 1.0).when(x < -limit, 0.0).otherwise(1 / (1 + F.exp(-x)))


class _Fields(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.links, self.meta, self.inside = [], [], [], {}, []

    def handle_starttag(self, tag, attrs):
        known = {k: v or "" for k, v in attrs}
        if tag == "meta" and known.get("name", "").lower() in ("keywords", "description"):
            self.meta[known["name"].lower()] = known.get("content", "")
        elif tag in ("script", "style", "title", "a"):
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data):
        if "script" in self.inside or "style" in self.inside:
            return
        (self.title if "title" in self.inside else self.links if "a" in self.inside else self.text).append(data)


def parse_fields(html: str | None) -> dict[str, str]:
    parser = _Fields()
    parser.feed(html or "")
    parser.close()
    squeeze = lambda x: " ".join(" ".join(x).split())
    return {"title": squeeze(parser.title), "keywords": parser.meta.get("keywords", ""), "links": squeeze(parser.links), "text": squeeze(parser.text), "description": parser.meta.get("description", "")}


FIELDS = ["title", "keywords", "links", "text", "description"]


def _fields_of(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in html:
        yield pd.DataFrame([parse_fields(x) for x in part], columns=FIELDS)


def html_fields(html: Column) -> Column:
    """Struct of five text fields of a page; handles real markup and entities. A null page has empty fields."""
    return F.pandas_udf(_fields_of, ", ".join(f"{n} string" for n in FIELDS))(html)


def _inflated(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zlib.decompress(x).decode("utf-8", "replace"))


def inflate(data: Column) -> Column:
    """Text of zlib-compressed bytes."""
    return F.pandas_udf(_inflated, "string")(data)


def _deflated(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else zlib.compress(x.encode("utf-8", "surrogatepass")))


def deflate(text: Column) -> Column:
    """zlib-compressed bytes of a text."""
    return F.pandas_udf(_deflated, "binary")(text)
