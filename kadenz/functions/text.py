"""Text functions: cleaning, tokens, formatted names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The cleaning chain, in order. Letters, digits and some marks stay, contractions are split, marks spaced.
#: The last pattern takes the character before a comma; at that point it is a space.
CLEANING = (
    (r"[^A-Za-z0-9(),!?'`]", " "), (r"'s", " 's"), (r"'ve", " 've"), (r"n't", " n't"), (r"'re", " 're"), (r"'d", " 'd"), (r"'ll", " 'll"),
    (r",", " , "), (r"!", " ! "), (r"\(", " ( "), (r"\)", " ) "), (r"\?", " ? "), (r"\s{2,}", " "), (r"., ", " , "),
)


def cleaned(text: Column) -> Column:
    return F.lower(F.trim(reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), CLEANING, text)))


def cleaned_sql(text: str) -> str:
    """The chain in DuckDB."""
    return "lower(trim(" + reduce(lambda c, p: f"regexp_replace({c}, '{p[0].replace(chr(39), chr(39) * 2)}', '{p[1].replace(chr(39), chr(39) * 2)}', 'g')", CLEANING, text) + "))"


def tokens(text: Column) -> Column:
    """Words of the cleaned text; an empty text has none."""
    return F.filter(F.split(cleaned(text), " "), lambda w: w != "")


def lexicon_tokens(text: Column) -> Column:
    """Lowered, stripped of ` .,-'`, split at spaces and commas, without empty ones."""
    return F.filter(F.split(F.btrim(F.lower(text), F.lit(" .,-'")), "[ ,]"), lambda w: w != "")


def edge_stripped(words: Column) -> Column:
    """Without non-word edges, hyphens split; empty parts and bare marks dropped."""
    bare = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"^[^-\w']+", ""), r"[^-\w']+$", ""))
    return F.filter(F.flatten(F.transform(bare, lambda w: F.split(w, "-"))), lambda w: ~w.isin("", "-", "'"))


def parameter_hash(text: Column) -> Column:
    return F.sha2(F.lower(F.replace(text, F.lit("."), F.lit("-"))), 256)


def fixed_length(ids: Column, n: int) -> Column:
    """Padded with 0 or cut; unknown ids (null) become 1."""
    return F.slice(F.concat(F.transform(ids, lambda x: F.coalesce(x, F.lit(1))), F.array_repeat(F.lit(0), n)), 1, n)


def compact_name(params: Column) -> Column:
    """Sorted key=value joined by _, empty values skipped, commas, spaces and dots removed."""
    entries = F.filter(F.array_sort(F.map_entries(params)), lambda e: F.coalesce(e.value, F.lit("")) != "")
    return F.translate(F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e.key, e.value)), "_"), ", .", "")


def clock(seconds: Column) -> Column:
    """HH:MM:SS,mmm as subtitle files have it."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
