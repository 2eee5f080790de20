"""Names and marked-up text."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that may stand before a name, kinds of saints, and words for a department (fixed values).
_ARTICLES, _SAINTS, _DEPARTMENT = ("le", "la", "les"), ("saint", "sainte"), ("", "dep", "dép", "dept", "dépt", "dep.", "dép.")


def _marked_letters() -> dict[str, str]:
    """Letters of Latin script that decompose into a plain letter and marks, with that letter."""
    letters = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for c in range(0xC0, 0x250)}
    return {c: plain for c, plain in letters.items() if c == c.lower() and plain.isascii() and plain.isalpha()}


def _department_codes() -> list[str]:
    """Codes of departments: numbers of two digits, the two Corsican ones and five overseas."""
    return [f"{n:02d}" for n in range(1, 96)] + ["2A", "2B"] + [str(n) for n in range(971, 977)]


def plain_letters(text: Column) -> Column:
    """Lower case, without marks (composed or combining) and ligatures."""
    to = _marked_letters()
    bare = F.regexp_replace(F.translate(F.lower(text), "".join(to) + "’", "".join(to.values()) + "'"), r"\p{M}+", "")
    return F.replace(F.replace(bare, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))


def name_key(name: Column) -> Column:
    """Loose key of a place name, of its words: without an article before them, saints of either kind alike (F-02)."""
    bare = F.regexp_replace(plain_letters(name), f"^(?:(?:{'|'.join(_ARTICLES)}) |l')", "")  # named once: a copy of the expression for each use would be computed again
    words = F.split(bare, r"[-\s'._]+")
    return F.array_join(F.transform(words, lambda w: F.when(w.isin(*_SAINTS), F.lit("st")).otherwise(w)), "")


def strip_parenthesis(name: Column) -> Column:
    """A name without what stands in parentheses at its end (F-03)."""
    bare = F.trim(name)
    return F.when(F.endswith(bare, F.lit(")")), F.trim(F.substring_index(bare, "(", 1))).otherwise(bare)


def department_hint(note: Column) -> Column:
    """Code of the department that a note consists of, with or without a word for it, or null (F-03)."""
    low = F.lower(F.trim(note))
    code = F.upper(F.regexp_extract(low, r"^\D*?\s*(\d+|2[ab])$", 1))
    word = F.trim(F.substring(low, F.lit(1), F.length(low) - F.length(code)))
    full = F.when(F.length(code) == 1, F.lpad(code, 2, "0")).otherwise(code)
    return F.when(word.isin(*_DEPARTMENT) & full.isin(*_department_codes()), full)


def strip_tags(text: Column) -> Column:
    s = F.regexp_replace(text, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def list_items(markup: Column) -> Column:
    """Array of the texts of list items (F-03)."""
    return F.transform(F.regexp_extract_all(markup, F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1)), strip_tags)


def tag_value(markup: Column, tag: str) -> Column:
    """Text of the first element of a tag, or null."""
    found = F.regexp_extract(markup, rf"(?s)<(?:\w+:)?{tag}[^>]*>(.*?)</(?:\w+:)?{tag}>", 1)
    return F.when(found != "", strip_tags(found))
