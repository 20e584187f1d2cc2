"""Text expressions: tokens, captions, labels, chunks."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Accented Latin letters and what is left of them without their marks, by Unicode's decomposition; then the marks themselves."""
    pairs = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii():
            pairs[c] = base
    return "".join(pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(pairs.values())


def folded(text: Column) -> Column:
    """Text without the accents of Latin letters, written in one sign or two."""
    return F.translate(text, *_folding())


def tokens(text: Column, accents: bool = True) -> Column:
    """Runs of letters and digits in lower case; with accents=False without the accents of Latin letters."""
    low = F.lower(text)
    return F.regexp_extract_all(low if accents else folded(low), F.lit(TOKEN), F.lit(0))


def query_words(query: str) -> list[str]:
    """The words of a search: those of more than one character, or all if there are none."""
    import re

    found = re.findall(r"[^\W_]+", query.lower())
    return [w for w in found if len(w) > 1] or found


def ascii_words(text: Column) -> Column:
    """Split at everything but letters a to z and digits; keeps empty strings at the ends."""
    return F.split(F.lower(text), "[^a-zA-Z0-9]+")


def search_terms(text: Column) -> Column:
    """Every sign but ASCII letters, digits and blanks becomes a blank; what is longer than one letter stays, as written."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"[^a-zA-Z0-9\s]", " ")), r"\s+"), lambda w: F.length(w) > 1)


def content_words(text: Column, stop: list[str]) -> Column:
    """Runs of a to z that aren't stop words, with repeats."""
    held = F.array(*[F.lit(s) for s in stop]) if stop else F.array().cast("array<string>")
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: ~F.array_contains(held, w))


def names_any(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands in the text as a word."""
    import re

    return text.rlike(r"(?i)\b(" + "|".join(map(re.escape, words)) + r")\b")


def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(text), F.lit(w.lower()))
    return hit


def expanded(query: Column, concepts: dict[str, list[str]]) -> Column:
    """The query, and behind it the words of each concept that it contains, in the map's order."""
    low = F.lower(query)
    return F.concat_ws(" ", query, *[F.when(F.contains(low, F.lit(c)), F.lit(" ".join(w))) for c, w in concepts.items()])


def expanded_by(queries: DataFrame, query: str, concepts: DataFrame, name: str) -> DataFrame:
    """queries with `expanded`: the query, and behind it the words of each concept of the map `name` that it contains.

    concepts: map, place, concept, words (in one string). Maps are small tables written by hand: they are sent to all tasks."""
    held = concepts.where(F.col("map") == name).agg(F.array_sort(F.collect_list(F.struct("place", "concept", "words"))).alias("_c"))
    j = queries.crossJoin(F.broadcast(held))
    hit = F.filter("_c", lambda c: F.contains(F.lower(F.col(query)), c["concept"]))
    return j.withColumn("expanded", F.concat_ws(" ", F.col(query), F.array_join(F.transform(hit, lambda c: c["words"]), " "))).withColumn("expanded", F.rtrim("expanded")).drop("_c")


def caption(objects: Column, personal: list[str], own: list[str], people: Column, place: Column, action: Column) -> Column:
    """objects: array<struct<label, conf, source>>. Personal things first, surest first, then others up to three in all,
    people, place and action; "nothing recognised" if there is nothing."""
    named = F.array(*[F.lit(x) for x in personal]) if personal else F.array().cast("array<string>")
    sources = F.array(*[F.lit(x) for x in own]) if own else F.array().cast("array<string>")
    ranked = F.array_sort(
        F.transform(objects, lambda o, i: F.struct((-o["conf"]).alias("c"), i.alias("i"), o["label"].alias("l"), (F.array_contains(sources, o["source"]) | F.array_contains(named, o["label"])).alias("p")))
    )
    firsts = F.filter(ranked, lambda o, i: ~F.exists(F.slice(ranked, 1, i), lambda b: b["l"] == o["l"]))
    mine = F.transform(F.filter(firsts, lambda o: o["p"]), lambda o: o["l"])
    rest = F.transform(F.filter(firsts, lambda o: ~o["p"]), lambda o: o["l"])
    labels = F.concat(mine, F.slice(rest, 1, F.greatest(F.lit(0), F.lit(3) - F.size(mine))))
    n = F.size(labels)
    things = F.when(n == 0, F.lit(None)).when(n <= 2, F.concat_ws(" and ", labels)).otherwise(
        F.concat(F.concat_ws(", ", F.slice(labels, 1, n - 1)), F.lit(" and "), F.element_at(labels, -1))
    )
    some = F.when(people == 1, F.lit("1 person")).when(people > 1, F.concat(people.cast("string"), F.lit(" people")))
    where = F.when(place.startswith("inside "), place).otherwise(F.concat(F.lit("in "), place))
    text = F.concat_ws(", ", things, some, where, action)
    return F.when(text == "", F.lit("nothing recognised")).otherwise(text)


def clock(seconds: Column) -> Column:
    """MM:SS, with hours in front from an hour on."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("long")
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def class_name(name: Column) -> Column:
    """The text before a slash, trimmed, in small letters; key means keys."""
    one = F.lower(F.trim(F.element_at(F.split(name, "/"), 1)))
    return F.when(one == "key", "keys").otherwise(one)


def error_text(kind: Column, message: Column) -> Column:
    return F.substring(F.regexp_replace(F.concat(kind, F.lit(": "), F.coalesce(message, F.lit(""))), ": $", ""), 1, 200)


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def size_number(text: Column) -> Column:
    """20k means 20000."""
    k = F.lower(F.trim(text)).endswith("k")
    n = F.regexp_extract(F.trim(text), r"^(\d+)", 1)
    return F.when(n != "", n.cast("long") * F.when(k, 1000).otherwise(1))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")


def answer_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"(?i)^answer:\s*", ""))


def job_label(status: Column, stage_no: Column, stages: int, attempts: Column, error: Column) -> Column:
    running = F.format_string(f"stage %d of {stages}", F.least(stage_no + 1, F.lit(stages)))
    failed = F.concat(F.lit("failed after "), attempts.cast("string"), F.lit(" attempts: "), F.coalesce(error, F.lit("unknown")))
    return F.when(status == "running", running).when(status == "failed", failed).otherwise(status)


def word_chunks(text: Column, size: int = 195, overlap: int = 30, ceiling: int | None = None) -> Column:
    """array<struct<chunk, n_words>>: runs of `size` words that share `overlap` with the one before; a short text as it is.

    Words are split at white space. The last chunk is the first that reaches the end."""
    words = F.split(text, r"\s+")
    n, step = F.size(words), max(1, size - overlap)
    width = min(size, ceiling) if ceiling else size
    count = F.ceil(F.greatest(F.lit(0), n - size) / step) + 1
    starts = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: (i * step).cast("int"))
    long = F.transform(starts, lambda s: F.struct(
        F.concat_ws(" ", F.slice(words, s + 1, width)).alias("chunk"), F.size(F.slice(words, s + 1, width)).alias("n_words")))
    return F.when(n > size, long).otherwise(F.array(F.struct(text.alias("chunk"), n.alias("n_words"))))
