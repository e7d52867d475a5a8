"""One spelling for names that sources write in different ways, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

#: Generational suffixes, as they stand at the end of a name.
SUFFIXES = ("Jr", "Sr", "II", "III", "IV")


def _accents() -> tuple[str, str]:
    """Latin letters that are one ASCII letter with marks, and those letters: by Unicode decomposition, so no table is kept."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(plain) == 1 and plain[0].isascii() and plain[0].isalpha():
            pairs.append((chr(code), plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _accents()


def unaccented(text: Column) -> Column:
    """Latin letters without marks, whether composed or followed by combining ones."""
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{M}", "")


def title_case(text: Column) -> Column:
    """A letter is large if no letter stands before it, also after digits and apostrophes, else small."""
    words = F.split(F.lower(text), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def normalised(name: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """A name without accents, dots, bracketed parts and a closing suffix, in title case, by alias. Null: empty.

    The sides of "A + B" and of "A vs B" are names of their own; they come back joined by " + " and by " vs. ".
    """
    bare = F.translate(F.translate(unaccented(F.coalesce(name, F.lit(""))), ".", ""), "’", "'")
    bare = F.regexp_replace(bare, r"[(\[][^)\]]*[)\]]", "")
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None

    def one(side: Column) -> Column:
        titled = title_case(F.trim(F.regexp_replace(F.trim(side), f" (?:{'|'.join(SUFFIXES)})$", "")))
        return F.coalesce(known[titled], titled) if known is not None else titled

    def sides(pattern: str, joint: str) -> Column:
        return F.array_join(F.transform(F.split(bare, pattern), one), joint)

    return F.when(bare.contains("+"), sides(r"\+", " + ")).otherwise(sides(r"(?i) vs ", " vs. "))


def sides_of(entity: Column) -> Column:
    """The names in a combined or head-to-head entity: array of (name, sign); what comes after "vs." counts against the first."""
    versus = entity.contains(" vs. ")
    parts = F.split(entity, r" \+ | vs\. ")
    return F.transform(parts, lambda p, i: F.struct(F.trim(p).alias("name"), F.when(versus & (i > 0), -1).otherwise(1).alias("sign")))
