"""Names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKERS = ("nothovar.", "nothosubsp.", "var.", "f.", "subsp.")


def normalized(name: Column) -> Column:
    """Underscores as spaces, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.replace(name, F.lit("_"), F.lit(" "))), r"\s+", " "))


def matching(name: Column) -> Column:
    """Normalised, and the hybrid sign an x."""
    return F.replace(normalized(name), F.lit("×"), F.lit("x"))


def slug(name: Column) -> Column:
    return F.replace(normalized(name), F.lit(" "), F.lit("-"))


def without_markers(name: Column) -> Column:
    return F.array_join(F.filter(F.split(normalized(name), " "), lambda t: ~t.isin(*MARKERS)), " ")


def cleaned(name: Column, rank: Column) -> Column:
    """The parts of a scientific name that its rank needs, joined by underscores."""
    t = F.split(F.trim(name), r"\s+")
    two = F.when(F.element_at(F.concat(t, F.array(F.lit(""), F.lit(""))), 2) == "×", 3).otherwise(2)
    three = F.when(F.exists(t, lambda x: x.isin(*MARKERS)), 4).otherwise(3)
    n = F.when(rank == "SPECIES", two).when(rank.isin("SUBSPECIES", "VARIETY", "FORM"), three).otherwise(F.size(t))
    return F.array_join(F.slice(t, F.lit(1), n), "_")


def title_case(name: Column) -> Column:
    """Words in title case: short words in capitals stay; of a word with an apostrophe only the first letter is capital, and
    an apostrophe at the end goes; in others each part between hyphens has one. Outer spaces go."""
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    capitals = lambda w: (F.length(w) <= 4) & (w == F.upper(w)) & (w != F.lower(w))
    quoted = lambda w: cap(F.regexp_replace(w, r"^([^']*)'$", "$1"))
    word = lambda w: F.when(capitals(w), w).when(w.contains("'"), quoted(w)).otherwise(F.array_join(F.transform(F.split(w, "-"), cap), "-"))
    return F.trim(F.array_join(F.transform(F.split(name, " "), word), " "))


# Licenses in order of preference, those that may be used at all, and what short codes stand for.
LICENSE_ORDER = (("publicdomain", 0), ("cc0", 0), ("/by/4", 1), ("/by/3", 1), ("/by/2", 1), ("cc by ", 1), ("/by-sa/", 2), ("cc by-sa", 2), ("/by-nc/", 3), ("cc by-nc ", 3), ("/by-nc-sa/", 4), ("cc by-nc-sa", 4))
LICENSE_USABLE = ("cc0", "cc by", "cc-by", "/by/", "/by-nd/", "/by-sa/", "/by-nc/", "/by-nc-sa/", "/by-nc-nd/", "publicdomain", "public domain")
LICENSE_CODES = ("cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd")
PUBLIC_DOMAIN = "https://creativecommons.org/publicdomain/zero/1.0/"


def license_score(url: Column) -> Column:
    """0 for the most free to 4, 99 for none of the known ones."""
    u, out = F.trim(F.lower(F.coalesce(url, F.lit("")))), F.lit(99)
    for part, score in reversed(LICENSE_ORDER):
        out = F.when(u.contains(part), score).otherwise(out)
    return out


def license_usable(url: Column) -> Column:
    u = F.trim(F.lower(F.coalesce(url, F.lit(""))))
    return (u == "pd") | F.exists(F.array(*map(F.lit, LICENSE_USABLE)), lambda part: u.contains(part))


def license_url(raw: Column) -> Column:
    """A short code's address; an address in its https form."""
    u = F.trim(raw)
    code = F.lower(u)
    known = F.when(code.isin("cc0", "pd"), PUBLIC_DOMAIN).when(code.isin(*LICENSE_CODES), F.concat(F.lit("https://creativecommons.org/licenses/"), F.regexp_replace(code, "^cc-", ""), F.lit("/4.0/")))
    return F.coalesce(known, F.regexp_replace(u, "^(.*?)http://", "$1https://"))


def license_label(url: Column) -> Column:
    """A short label of an address; other texts as they are, none for blank."""
    zero = F.regexp_extract(url, "/publicdomain/zero/([^/]+)/", 1)
    kind, version = (F.regexp_extract(url, "/licenses/([^/]+)/([^/]+)/", i) for i in (1, 2))
    return F.when(zero != "", F.concat(F.lit("CC0 "), zero)).when(kind != "", F.concat(F.lit("CC "), F.upper(kind), F.lit(" "), version)).when(url != "", url)


def obscured_flag(note: Column) -> Column:
    n = F.trim(F.coalesce(note, F.lit("")))
    return F.when(n == "", "No").when(F.element_at(F.split(n, " "), -1) == "taxon", "Hidden").otherwise("Obscured")


def observation_id(text: Column) -> Column:
    """Digits, N.0, or the one run of digits in a text; null if there are more or none."""
    whole = F.regexp_extract(text, r"^\s*(\d+)(?:\.0+)?\s*$", 1)
    runs = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    return F.when(whole != "", whole).when(F.size(runs) == 1, F.element_at(runs, 1)).cast("long")


def phrase(value: Column, steps: list[tuple[float, str]], beyond: str) -> Column:
    """The label of the first limit that a value is under; null for null and NaN."""
    out = F.lit(beyond)
    for limit, label in reversed(steps):
        out = F.when(value < limit, label).otherwise(out)
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), out)
