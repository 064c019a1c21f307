"""Release files: allow-listed scans, manifests, deployment order, and copy with marked texts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import RICH_TEXT

RICH = re.compile(RICH_TEXT)
# The content type of each extension.
TYPES = {
    "html": "text/html; charset=utf-8", "css": "text/css; charset=utf-8", "js": "text/javascript; charset=utf-8", "json": "application/json",
    "xml": "application/xml; charset=utf-8", "txt": "text/plain; charset=utf-8", "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg",
    "jpeg": "image/jpeg", "webp": "image/webp", "ico": "image/x-icon", "woff": "font/woff", "woff2": "font/woff2",
}


def scan(spark: SparkSession, directory: str, allowed: list[str] | None = None) -> DataFrame:
    """(key, content) of a directory's files; Spark lists no empty ones. With `allowed`, just these keys, all of which must be there."""
    base = directory.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    found = files.select(F.substring_index("path", base, -1).alias("key"), "content")
    if allowed is None:
        return found
    kept = found.where(F.col("key").isin(*allowed))
    missing = set(allowed) - {r[0] for r in kept.select("key").collect()}
    if missing:
        raise FileNotFoundError(f"not among the files: {', '.join(sorted(missing))}")
    return kept


def checked(files: DataFrame) -> DataFrame:
    """The files; an error for names that begin with a dot and for extensions without a content type."""
    hidden = F.col("key").rlike(r"(^|/)\.")
    known = F.lower(F.substring_index("key", ".", -1)).isin(*TYPES)
    fault = F.raise_error(F.concat(F.lit("unexpected file: "), F.col("key"))).cast("boolean")
    return files.where(F.when(hidden | ~known, fault).otherwise(F.lit(True)))


def manifest(files: DataFrame) -> DataFrame:
    """key, bytes and sha256 of each file."""
    return files.select("key", F.octet_length("content").cast("long").alias("bytes"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def cache_class(key: Column) -> Column:
    return F.when(key.endswith(".html"), "no-cache").when(key.rlike(r"\.[a-f0-9]{16,}\.(css|js)$"), "public, max-age=31536000, immutable").otherwise("public, max-age=3600")


def deploy_plan(files: DataFrame) -> DataFrame:
    """key, size, etag, content_type, cache and priority; upload by priority, then key: the home page goes last."""
    types = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    priority = F.when(F.col("key") == "index.html", 2).when(F.col("key").endswith(".html"), 1).otherwise(0)
    return files.select("key", F.octet_length("content").cast("long").alias("size"), F.upper(F.md5(F.col("content").cast("binary"))).alias("etag"), F.element_at(types, F.substring_index("key", ".", -1)).alias("content_type"), cache_class(F.col("key")).alias("cache"), priority.alias("priority"))


def references_missing(references: DataFrame, files: DataFrame) -> DataFrame:
    """Referenced keys that are no file."""
    return references.select("key").distinct().join(files.select("key"), "key", "left_anti")


def stale(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that a check finds different: expected ones that are not stored as they are."""
    return expected.exceptAll(stored.select(expected.columns))


def marked_copy(source: str, mark: Callable[[str], str]) -> str:
    """A page's source with its lead lines and demo paragraphs marked.

    The page is read line by line, in one of four places. The front matter is between two lines
    `+++`; its list `lead` has one single-quoted string on a line. Below it stand demo blocks
    between short codes `reader-demo`, whose paragraphs are single lines with blank lines between.
    """
    out: list[str] = []
    place, marked = "top", {"lead": 0, "demo": 0}

    def put(kind: str, before: str, text: str, after: str) -> None:
        if RICH.search(text):
            raise ValueError("plain text, one line a paragraph, is needed")
        marked[kind] += 1
        out.append(before + mark(text) + after)

    last_blank = True
    for line in source.splitlines(keepends=True):
        body = line.rstrip("\r\n")
        end = line[len(body) :]
        if place == "top":
            if body != "+++":
                break
            place = "front"
        elif place == "front" and body == "+++":
            place = "text"
        elif place == "front" and not marked["lead"] and body.replace(" ", "").replace("\t", "") == "lead=[" and body.startswith("lead"):
            place = "lead"
        elif place == "lead" and body.startswith("]"):
            place = "front"
        elif place == "lead" and body.strip():
            quoted = body.strip(" \t").removesuffix(",").rstrip(" \t")
            if len(quoted) < 2 or quoted[0] + quoted[-1] != "''" or "'" in quoted[1:-1]:
                raise ValueError("lead lines are single-quoted")
            at = body.index("'") + 1
            put("lead", body[:at], quoted[1:-1], body[at + len(quoted) - 2 :] + end)
            continue
        elif place == "text" and "{{< reader-demo" in body:
            if not body.startswith("{{< reader-demo") or not body.endswith(" >}}") or not end:
                raise ValueError("a demo block has an unknown form")
            place, last_blank = "demo", True
        elif place == "demo" and body == "{{< /reader-demo >}}":
            place = "text"
        elif place == "demo" and body.strip(" \t"):
            if not last_blank:
                raise ValueError("plain text, one line a paragraph, is needed")
            last_blank = False
            put("demo", "", body, end)
            continue
        elif place == "demo":
            last_blank = True
        out.append(line)
    if place in ("top", "front", "lead"):
        raise ValueError("the front matter is missing")
    if place == "demo":
        raise ValueError("a demo block has an unknown form")
    if not all(marked.values()):
        raise ValueError("there are no " + ("lead lines" if not marked["lead"] else "demo blocks"))
    return "".join(out)


def scan_copy(spark: SparkSession, path: str) -> DataFrame:
    """(path, source) of text files, each whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("source"))


def release_url(url: Column, placeholder: str = "example.com") -> Column:
    """Whether an address may be released: https, with a host that is no placeholder."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#:]+)", 1))
    return F.coalesce((host != "") & (host != placeholder) & ~host.endswith("." + placeholder), F.lit(False))


def checked_pages(pages: DataFrame, opted_out: Column, placeholder: str = "example.com") -> DataFrame:
    """Built pages (key, html); an error for one without the opt-out or with a placeholder address."""
    bad = ~opted_out | F.col("html").contains(f"https://{placeholder}")
    return pages.where(F.when(bad, F.raise_error(F.concat(F.lit("not fit for release: "), F.col("key"))).cast("boolean")).otherwise(F.lit(True)))
