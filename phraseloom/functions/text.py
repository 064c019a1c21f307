"""Text functions as Spark columns. Public offsets count UTF-16 units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that end clauses, and number and word shapes.
LINE_ENDS = r"\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}"
PROXIES = "，。！？；…"
ENDS = PROXIES + "、" + LINE_ENDS
BOUNDARIES = [*PROXIES, *"\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029"]
BEYOND = r"[\x{10000}-\x{10FFFF}]"
SPACES = r"\t \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{feff}"
ANY_SPACE = SPACES + r"\n\x0B\f\r\x{2028}\x{2029}"
SIGN = r"[+\-−﹢﹣＋－]"
NUMBER = rf"{SIGN}?[{SPACES}]*(?:\p{{Nd}}+(?:[.．]\p{{Nd}}*)?|[.．]\p{{Nd}}+)(?:[eEｅＥ]{SIGN}?\p{{Nd}}+)?"
NUMERIC_COMMA = rf"(?<![\p{{Nd}}.．])({NUMBER}[{SPACES}]*)，([{SPACES}]*)(?={NUMBER})"
#: What any NUMERIC_COMMA matches in part, without looking behind: texts without it have none.
NEAR_NUMERIC_COMMA = rf"[\p{{Nd}}.．][{SPACES}]*，[{SPACES}]*{SIGN}?[{SPACES}]*[\p{{Nd}}.．]"
NUMERIC_EXPRESSION = rf"\p{{N}}+(?:[.,]\p{{N}}+)?(?:[{ANY_SPACE}]+\p{{N}}+[/／]\p{{N}}+|[/／]\p{{N}}+)?"
LATIN_WORD = "[A-Za-zＡ-Ｚａ-ｚ]+"
MASK = ""
HAN = r"\p{IsHan}"
DIVIDER = "｜"
# Fixed value: what plain copy may not hold.
RICH_TEXT = r"[<>\[\]*_`\\\r\n]|&(?:#\w+|\w+);"
#: A stand-in for Chinese text: letters and stops of other text as Han letters and Chinese stops.
PLAIN = "abcdefghijklmnopqrstuvwxyz.,;!?"
PROJECTED = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄。，；！？"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def han_projection(text: Column) -> Column:
    """Test device: gives text in Latin letters Han letters and Chinese stops, one for one."""
    return F.translate(F.lower(text), PLAIN, PROJECTED)


def utf16_length(text: Column) -> Column:
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def contains_han(text: Column) -> Column:
    return text.rlike(HAN)


def masked_numeric_commas(text: Column) -> Column:
    """The text with two characters for each `，` between two numbers of one line: MASK and `b`; a MASK of the text gets an `a`, so that `unmasked` finds the text again."""
    once = F.regexp_replace(F.replace(text, F.lit(MASK), F.lit(MASK + "a")), NUMERIC_COMMA, f"$1{MASK}b$2")
    return F.when(text.contains("，"), once).otherwise(F.replace(text, F.lit(MASK), F.lit(MASK + "a")))


def unmasked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MASK + "b"), F.lit("，")), F.lit(MASK + "a"), F.lit(MASK))


def split_clauses(text: Column) -> Column:
    """Clauses: what is between ends, each with the whole run of ends after it. Their concatenation is the text."""
    pattern = F.lit(f"[^{ENDS}]*[{ENDS}]+|[^{ENDS}]+")
    masked = lambda t: F.transform(F.regexp_extract_all(masked_numeric_commas(t), pattern, F.lit(0)), unmasked)
    return let(text, lambda t: F.when(t.contains("，") & t.rlike(NEAR_NUMERIC_COMMA), masked(t)).otherwise(F.regexp_extract_all(t, pattern, F.lit(0))))


def boundary_offsets(text: Column) -> Column:
    """UTF-16 offsets of `，。！？；…` and line ends, without commas inside numbers. One pass over the letters; one beyond U+FFFF stands as two."""
    words = lambda t: F.when(t.contains("，") & t.rlike(NEAR_NUMERIC_COMMA), F.regexp_replace(t, NUMERIC_COMMA, "$1b$2")).otherwise(t)
    wide = lambda t: F.when(t.rlike(BEYOND), F.regexp_replace(t, BEYOND, "bb")).otherwise(t)
    return let(let(text, words), lambda t: F.array_compact(F.transform(F.split(wide(t), ""), lambda c, i: F.when(c.isin(*BOUNDARIES), i))))


def visual_length(text: Column) -> Column:
    """Han letters, numbers and Latin words. Letters are counted by what their removal takes, without an array of them."""
    return F.length(text) - F.length(F.regexp_replace(text, HAN, "")) + F.regexp_count(text, F.lit(NUMERIC_EXPRESSION)) + F.regexp_count(text, F.lit(LATIN_WORD))


def adjacent_han(text: Column) -> Column:
    """Code-point offsets between two Han letters."""
    han = F.transform(F.split(text, ""), lambda c: c.rlike(HAN))
    pairs = let(han, lambda h: F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: a & b))
    return F.array_compact(F.transform(pairs, lambda both, i: F.when(both, i + 1)))


def joined_at(text: Column, offsets: Column, mark: str = DIVIDER) -> Column:
    """The text with a mark at each of the ascending code-point offsets."""
    return F.array_join(slices(text, offsets), mark)


def slices(text: Column, offsets: Column) -> Column:
    """The parts of the text between ascending code-point offsets."""
    part = lambda t, a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))
    cut = lambda t, o: F.zip_with(F.concat(F.array(F.lit(0)), o), F.concat(o, F.array(F.length(t))), lambda a, b: part(t, a, b))
    return let(text, lambda t: let(offsets.cast("array<int>"), lambda o: cut(t, o)))


def utf16_slices(text: Column, offsets: Column) -> Column:
    """The parts of the text between ascending UTF-16 offsets, none of which parts a surrogate pair.

    A letter beyond U+FFFF gets a filler, so that positions in the widened text are UTF-16 offsets.
    """
    wide = F.regexp_replace(text, r"([\x{10000}-\x{10FFFF}])", f"$1{MASK}")
    return F.transform(slices(wide, offsets), lambda p: F.regexp_replace(p, rf"([\x{{10000}}-\x{{10FFFF}}]){MASK}", "$1"))


def divider_spans(marked: Column) -> Column:
    """HTML of a marked copy: each divider in a span."""
    return F.array_join(F.split(marked, DIVIDER), '<span class="divider" aria-hidden="true"></span>')


def plain_copy(text: Column) -> Column:
    """The text; an error if it holds mark-up or several lines."""
    return F.when(text.rlike(RICH_TEXT), F.raise_error(F.lit("plain text of one line is needed"))).otherwise(text)
