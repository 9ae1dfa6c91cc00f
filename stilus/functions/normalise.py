"""Normalisers and tokenisers of raw text: tweets, quotes and spaces, accents, HTML, sentences."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stilus.functions.text import split_contractions, words


# -- tweets ---------------------------------------------------------------------------------------
#: Pieces of a tweet in the order they are tried: addresses, names and tags, smileys, words with inner
#: apostrophes or hyphens, numbers, runs of dots, any other sign.
_TWEET = r"(?:https?://|www\.)\S+|[@#][\w]+|[<>]?[:;=8][-o*']?[)\](\[dDpP/\\|]|[^\W\d_](?:[^\W_]|['’\-_](?=[^\W\d_]))*[^\W_]|[+\-]?\d+(?:[.,/:\-]\d+)*|(?:\.\s*){2,}|\w|[^\s\w]"


def tweet_tokens(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"(?U)" + _TWEET), F.lit(0))


def tweet_token(w: Column) -> Column:
    """Names of users become @USER, addresses HTTPURL, a curly apostrophe and an ellipsis their plain
    forms. Names of emoji need a table of names that isn't available; a sign stays."""
    low = F.lower(w)
    return F.when(w.startswith("@"), "@USER").when(low.startswith("http") | low.startswith("www"), "HTTPURL").when(w == "’", "'").when(w == "…", "...").otherwise(w)


def normal_tweet(t: Column) -> Column:
    """Tokens normalised and joined by spaces, contractions split off."""
    plain = F.replace(F.replace(t, F.lit("’"), F.lit("'")), F.lit("…"), F.lit("..."))
    return split_contractions(F.array_join(F.transform(tweet_tokens(plain), tweet_token), " "))


# -- signs ----------------------------------------------------------------------------------------
_QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "″": '"', "´": "'", "`": "'"}


def plain_quotes(t: Column) -> Column:
    return F.translate(t, "".join(_QUOTES), "".join(_QUOTES.values()))


def plain_spaces(t: Column) -> Column:
    """Spaces without width go, runs of line breaks become one, runs of other space one space, ends
    trimmed."""
    t = F.translate(t, "​⁠﻿", "")
    t = F.regexp_replace(t, r"(\r\n|[\n\x0b])+", "\n")
    return F.trim(F.regexp_replace(t, r"[^\S\n\x0b]+", " "))


def tabs_and_breaks_to_spaces(t: Column) -> Column:
    return F.translate(t, "\t\n", "  ")


@F.pandas_udf(StringType())
def composed(t: pd.Series) -> pd.Series:
    """Canonical composition (NFC); ASCII passes."""
    return t.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def _bare(x: str | None) -> str | None:
    if x is None or x.isascii():
        return x
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def without_accents(t: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; ASCII passes."""
    return t.map(_bare)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_text(x: str | None) -> str | None:
    """The text of an HTML fragment: tags and comments gone, entities read, scripts and styles left out."""
    if x is None or ("<" not in x and "&" not in x):
        return x
    p = _Text()
    p.feed(x)
    p.close()
    return "".join(p.parts)


@F.pandas_udf(StringType())
def from_html(t: pd.Series) -> pd.Series:
    return t.map(html_text)


# -- sentences and words --------------------------------------------------------------------------
_ABBREVIATIONS = r"(?<!\b(?:Mr|Ms|Dr|St|vs|Nr|No)\.)(?<!\b(?:Mrs|Prof|e\.g|i\.e|etc|bzw|z\.B|Sr|Sra)\.)"


def sentence_split(t: Column) -> Column:
    """Sentences: cut after a full stop, question or exclamation mark and its closing quotes before
    space, not after common abbreviations, and at line breaks. A substitute for a parser's sentences."""
    return F.filter(F.transform(F.split(t, r"\n+|(?<=[.!?…][\"')\]»”]{0,2})" + _ABBREVIATIONS + r"\s+"), lambda s: F.trim(s)), lambda s: s != "")


def treebank_tokens(t: Column) -> Column:
    """Words, contractions split as n't, 's and the like, and single punctuation marks."""
    return F.regexp_extract_all(t, F.lit(r"(?U)\w+(?=n't\b)|n't\b|'(?:s|re|ve|ll|d|m)\b|\w+(?:[-.]\w+)*|\.{2,}|[^\w\s]"), F.lit(0))


def word_and_sign_tokens(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"(?U)\w+|[^\w\s]+"), F.lit(0))


TOKENIZERS = {"space": words, "treebank": treebank_tokens, "casual": tweet_tokens, "signs": word_and_sign_tokens}


def tokenize(t: Column, tokenizer: str) -> Column:
    """Tokens by a tokeniser's name; `TOKENIZERS` may be extended by further column functions."""
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {tokenizer}; known: {sorted(TOKENIZERS)}")
    return TOKENIZERS[tokenizer](t)


def reflow(sentences: Column, width: int) -> Column:
    """Lines of at most `width` tokens of an array of sentences: each sentence begins with <SOS> and ends
    with <EOS>; a longer one is cut, its pieces ending in <ELB> and going on with <SLB>. A sentence
    without tokens gives <SOS> <EOS>."""

    def lines(s: Column) -> Column:
        w = words(s)
        size, step = F.size(w), width - 2
        pieces = F.greatest(F.ceil(size / float(step)), F.lit(1)).cast("int")

        def piece(i: Column) -> Column:
            begin = F.when(i == 0, "<SOS>").otherwise("<SLB>")
            end = F.when(i == pieces - 1, "<EOS>").otherwise("<ELB>")
            return F.array_join(F.concat(F.array(begin), F.slice(w, i * step + 1, F.lit(step)), F.array(end)), " ")

        return F.transform(F.sequence(F.lit(0), pieces - 1), piece)

    return F.flatten(F.transform(sentences, lines))


def tweet_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, preprocessed, tokens): tweets masked and tokenised; tags need a tagger that isn't available."""
    from stilus.functions.text import mask_tweet

    masked = df.select(key, mask_tweet(F.col(text)).alias("preprocessed"))
    return masked.withColumn("tokens", tweet_tokens(F.col("preprocessed")))


