"""Word segmenters protect words from cuts: callables from a text to (start, end) code-point ranges of words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class FixedRanges:
    """The same ranges in every text."""

    ranges: tuple[tuple[int, int], ...]

    def __call__(self, text: str) -> list[tuple[int, int]]:
        return list(self.ranges)


@dataclass(frozen=True)
class Dictionary:
    """Longest words of a list, from left to right."""

    words: frozenset[str]

    def __call__(self, text: str) -> list[tuple[int, int]]:
        longest = max(map(len, self.words), default=0)
        out, at = [], 0
        while at < len(text):
            size = next((n for n in range(min(longest, len(text) - at), 0, -1) if text[at : at + n] in self.words), 1)
            if text[at : at + size] in self.words:
                out.append((at, at + size))
            at += size
        return out


def inside_word(ranges: list[tuple[int, int]], boundary: int) -> bool:
    return any(a < boundary < b for a, b in ranges)


def icu_words(spark: SparkSession, text: str, locale: str = "zh-CN") -> list[tuple[int, int]]:
    """Words by the ICU library among Spark's jars, on the driver, in UTF-16 units; for small word lists and tests."""
    jvm = spark.sparkContext._jvm
    rules = jvm.com.ibm.icu.text.BreakIterator.getWordInstance(jvm.com.ibm.icu.util.ULocale(locale))
    rules.setText(text)
    out, start = [], rules.first()
    while (end := rules.next()) != -1:
        if rules.getRuleStatus() >= 100:
            out.append((start, end))
        start = end
    return out
