"""String rules as Column expressions. Lexicons and patterns are arguments; the defaults are in lexicons.py."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() and str.split() take as white space, in a Java character class used with (?U).
WS = r"[\s\x1c-\x1f]"
#: Stands between the pieces of a sentinel split; inputs lose it first.
SENTINEL = "\x01"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")


def rstrip_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\t\x0B\f \x1c-\x1f\x85\p{Zs}\p{Zl}\p{Zp}]+(?=\n|\z)", "")


def newlines(c: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.trim(c), r"\\", "/"), "/"), -1)


def first_id(c: Column) -> Column:
    """The first run of digits as a canonical integer string; '' if there is none."""
    digits = F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d+)", 1)
    bare = F.regexp_replace(digits, "^0+", "")
    return F.when((digits != "") & (bare == ""), "0").otherwise(bare)


def count_or_zero(c: Column) -> Column:
    """Unsigned integer of a text with commas; 0 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), ",", ""), r"\d+", 0), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def signed_or_null(c: Column) -> Column:
    """Signed integer of a text with commas; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, ",", ""), r"-?\d+", 0), F.lit("")).try_cast("bigint")


def mime_parts(c: Column) -> Column:
    """struct(base, charset): the lower-cased type and its charset with - for _."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), F.trim), lambda p: p != "")
    named = F.filter(F.slice(parts, 2, 1000), lambda p: F.lower(F.trim(F.substring_index(p, "=", 1))).eqNullSafe(F.lit("charset")) & F.contains(p, F.lit("=")))
    value = F.regexp_replace(F.trim(F.regexp_replace(F.try_element_at(named, F.lit(1)), r"^[^=]*=", "")), '^"+|"+$', "")
    return F.struct(F.lower(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))).alias("base"), F.coalesce(F.lower(F.translate(value, "_", "-")), F.lit("")).alias("charset"))


def is_english(languages: Column) -> Column:
    return F.exists(languages, lambda x: (x == "en") | F.startswith(x, F.lit("en-")))


def words_array(lexicon: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in lexicon])


def hits(text: Column, lexicon: Sequence[str]) -> Column:
    """The words of a lexicon that occur in text as substrings (case folded), sorted."""
    low = F.lower(text)
    return F.array_sort(F.array_distinct(F.filter(words_array(lexicon), lambda w: F.contains(low, w))))


def has_any(text: Column, lexicon: Sequence[str]) -> Column:
    low = F.lower(text)
    return F.exists(words_array(lexicon), lambda w: F.contains(low, w))


def mostly_upper(c: Column, share: float = 0.6) -> Column:
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return (letters > 0) & (F.regexp_count(c, F.lit(r"\p{Lu}")) >= share * letters)


def is_prose_line(c: Column) -> Column:
    return (F.length(c) >= 70) & (F.regexp_count(c, F.lit("[A-Za-z]+")) >= 10)


def normalise(c: Column) -> Column:
    """Trimmed, white space folded, lower case."""
    return F.lower(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), rf"(?U){WS}+", " "))


def phrase_flags(text: Column, phrases: Sequence[str]) -> Column:
    norm = normalise(text)
    return F.transform(words_array(phrases), lambda p: F.contains(norm, p))


def preview(c: Column, width: int = 80) -> Column:
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")
    cut = F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)
    return F.replace(cut, F.lit("|"), F.lit("\\|"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def run_name(c: Column) -> Column:
    """A name fit for a folder: other characters become -, none at the ends; 'run' if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "-"), r"^[-._]+|[-._]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("run"))


def sample_seed(*parts: Column) -> Column:
    """A deterministic seed below 2^31 of the parts joined by |: the low 31 bits of the first eight bytes of SHA-256."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(key, 256), 9, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(2147483647))
