"""Text functions, Column to Column."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the sources of these corpora count it, and what ends a line.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Letters whose capital is more than one code point in full, and what each becomes alone, as SQL engines have it.
LONG = "".join(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if len(c.upper()) > 1)
CAPITAL = "".join("\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in LONG)

# The lines around a book's text.
BOOK_START = r"(?i)\*{3}\s*START OF (THE|THIS) PROJECT GUTENBERG EBOOK"
BOOK_END = r"(?i)\*{3}\s*END OF (THE|THIS) PROJECT GUTENBERG EBOOK"

# Patterns counted as marks of deduction and of hedging.
DEDUCTION = [
    r"\btherefore\b", r"\bthus\b", r"\bhence\b", r"\bclearly\b", r"\bevidently\b", r"\bmust be\b", r"\bcan only\b",
    r"\bit follows\b", r"\bI deduce\b", r"\bthis indicates\b", r"\bthis suggests\b", r"\bI conclude\b", r"\bthis means\b",
    r"\bit is clear\b", r"\bobviously\b", r"\bwithout doubt\b", r"\bwithout question\b", r"\bwe can see\b", r"\bone can see\b",
]
HEDGING = [
    r"\bmaybe\b", r"\bperhaps\b", r"\bmight\b", r"\bcould be\b", r"\bpossibly\b", r"\bI'm not sure\b", r"\bI am not sure\b",
    r"\bI think\b", r"\bI guess\b", r"\buncertain\b", r"\bunclear\b", r"\bhard to say\b",
    r"\bdifficult to (say|determine|know)\b", r"\bcan't be sure\b", r"\bcannot be sure\b",
]

# A labelling answer's fields.
LABEL = r"(?i)LABEL\s*:\s*(none|minor|central)"
REASON = r"(?i)JUSTIFICATION\s*:\s*([^\n]+)"

# A turn's fields in text that is not JSON, and its kinds of trap.
TRAPS = ["knowledge_cutoff", "sensory", "numeric", "self_reference", "none"]


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once however often use names it."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def _each_code_point(text: Column, use) -> Column:
    return F.array_join(F.transform(F.split(text, ""), use), "")


def upper(text: Column) -> Column:
    """Capitals code point by code point, so no text grows (F.upper makes two letters of a sharp s)."""
    return _each_code_point(text, lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, LONG, CAPITAL)))


def lower(text: Column) -> Column:
    """Small letters code point by code point: a sigma is one whatever follows it, and a dotted capital I an i."""
    return _each_code_point(text, lambda c: F.when(c == "\u0130", "i").otherwise(F.lower(c)))


def words(text: Column) -> Column:
    """Runs of what is not white. A translation and a split at one character take a quarter of the time of a pattern over all white characters."""
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("int")


def token_estimate(word_total: Column) -> Column:
    """Tokens for a total of words: 1.33 each, cut to a whole number after the sum."""
    return F.floor(word_total * F.lit(1.33)).cast("long")


def normalize_whitespace(text: Column) -> Column:
    """No space at line ends, at most two empty lines in a row, none at either end, one line break at the end."""
    lines = F.regexp_replace(text, LINE_END, "\n")
    ends = F.regexp_replace(lines, r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000&&[^\n]]+(?=\n|\z)", "")
    few = F.regexp_replace(ends, r"\n{4,}", "\n\n\n")
    return F.concat(F.regexp_replace(few, r"\A\n+|\n+\z", ""), F.lit("\n"))


def between_markers(lines: Column, start: str = BOOK_START, end: str = BOOK_END) -> Column:
    """Lines strictly between the first that matches start and the first later one that matches end; null if either is missing."""
    first = F.array_position(F.transform(lines, lambda x: x.rlike(start)), True).cast("int")
    rest = F.slice(lines, first + 1, F.size(lines))
    last = F.array_position(F.transform(rest, lambda x: x.rlike(end)), True).cast("int")
    return F.when((first > 0) & (last > 0), F.array_join(F.slice(rest, 1, last - 1), "\n"))


def paragraphs(text: Column, separator: str = r"\n{2,}") -> Column:
    return F.split(text, separator, -1)


def preview(text: Column, size: int) -> Column:
    return F.translate(F.substring(text, 1, size), "\n", " ")


def parse_label(answer: Column) -> Column:
    """none, minor or central; parse_error where the answer names none of them."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(answer, LABEL, 1)), F.lit("")), F.lit("parse_error"))


def parse_reason(answer: Column) -> Column:
    """The rest of the reason's line, or the whole answer without one."""
    return F.coalesce(F.nullif(strip(F.regexp_extract(answer, REASON, 1)), F.lit("")), answer)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|||", *parts), 256)


#: How a marker may begin and end: at the edge of a word, by either way to say so.
EDGES = ((r"\b", r"\b"), (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"))


def _literals(pattern: str, edges: tuple[str, str] = EDGES[0]) -> list[str]:
    """The lower-cased texts that a marker of words, single blanks, apostrophes and at most one choice stands for; none where it is of another form."""
    first, last = map(re.escape, edges)
    form = re.fullmatch(rf"{first}([A-Za-z][A-Za-z' ]*)(?:\(([A-Za-z|]+)\))?{last}", pattern)
    return [form[1].lower() + end for end in (form[2] or "").lower().split("|")] if form else []


def _alone(texts: list[str], others: list[str]) -> bool:
    """Whether no text can stand in another at its place, nor overlap itself."""
    at_once = lambda x, y: x != y and (x + " ").startswith(y + " ") or (x + "'").startswith(y + "'")
    border = lambda x: any(x[:k] == x[-k:] and not x[k].isalpha() for k in range(1, len(x)))
    return not any(border(x) for x in texts) and not any(x == y or at_once(x, y) or at_once(y, x) for x in texts for y in others)


@functools.cache
def marker_passes(patterns: tuple[str, ...]) -> list[str]:
    """Patterns over lower-cased text whose matches are together those of all the markers, each counted on its own.

    Markers that are plain words go into one: at the start of a word, its first letter chooses among them, and what follows is looked
    at ahead, so that markers may overlap. Others, and such as can match where another does, stay patterns of their own.
    """
    out, rest = [], list(patterns)
    for edges in EDGES:
        held: list[str] = []
        for p in list(rest):
            texts = _literals(p, edges)
            if texts and _alone(texts, held) and len(set(texts)) == len(texts):
                held += texts
                rest.remove(p)
        letters: dict[str, list[str]] = {}
        for x in held:
            letters.setdefault(x[0], []).append(x[1:])
        one = "|".join(f"{c}(?=(?:{'|'.join(ends)}){edges[1]})" for c, ends in letters.items())
        # a look at the letter comes first, as it costs less than one for the start of a word
        out += [f"(?=[{''.join(letters)}]){edges[0]}(?:{one})"] if held else []
    return out + [f"(?i){p}" for p in rest]


def marker_count(text: Column, patterns: list[str]) -> Column:
    """Matches of all patterns in lower-cased text, each counted on its own, whatever their case."""
    passes = marker_passes(tuple(patterns))
    return let(F.lower(text), lambda low: sum((F.regexp_count(low, F.lit(p)) for p in passes), F.lit(0)).cast("int"))


def marker_density(more: Column, less: Column, count: Column) -> Column:
    """(more - less) for a thousand words, to four places."""
    return F.round((more - less) / F.greatest(count, F.lit(1)) * 1000, 4)


def unfence(answer: Column) -> Column:
    cut = lambda bare: F.regexp_replace(F.regexp_replace(bare, r"\A```[a-z]*\n?", ""), r"\n?```\s*\z", "")
    return let(strip(answer), lambda bare: F.when(bare.startswith("```"), cut(bare)).otherwise(bare))


TURN_DDL = "reply string, suspicion_score double, reasoning_trace string, cues array<string>, trap_strategy struct<plan: string, type: string>, public_accusation boolean"


def parse_turn(answer: Column) -> Column:
    """A turn from an answer: JSON, fenced or with text around it, else what single fields can be found.

    Scores are brought into [0, 1], 0.5 where missing. A field of the wrong type counts as missing. A reply found
    outside of JSON may be empty; only where there is none, the answer's beginning stands for it.
    """
    options = {"columnNameOfCorruptRecord": "_bad"}
    read = lambda raw: F.from_json(raw, f"{TURN_DDL}, _bad string", options)
    good = lambda raw: let(read(raw), lambda s: F.when(s["_bad"].isNull() & raw.rlike(r"(?s)\A\s*\{"), s))
    blob = lambda body: F.regexp_extract(body, r"(?s)\{.*\}", 0)
    # each step is bound once; the blob inside a text is looked for only where the whole is no JSON
    parsed_of = lambda body: let(good(body), lambda whole: F.when(whole.isNotNull(), whole).otherwise(let(blob(body), good)))

    def field(name: str, value: str) -> Column:
        """The field's value, which may be empty; null where there is none."""
        return F.try_element_at(F.regexp_extract_all(answer, F.lit(rf'(?s)"{name}"\s*:\s*{value}'), F.lit(1)), F.lit(1))

    quoted = r'"((?:[^"\\]|\\.)*)"'
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.5))))
    found = F.struct(
        F.coalesce(field("reply", quoted), strip(F.substring(answer, 1, 300))).alias("reply"),
        clamp(field("suspicion_score", r"(\d+(?:\.\d+)?)").cast("double")).alias("suspicion_score"),
        F.coalesce(field("reasoning_trace", quoted), F.lit("")).alias("reasoning_trace"),
        F.array().cast("array<string>").alias("cues"),
        F.coalesce(field("plan", quoted), F.lit("")).alias("plan"),
        F.coalesce(field("type", f'"({"|".join(TRAPS)})"'), F.lit("none")).alias("trap"),
        (F.lower(F.coalesce(field("public_accusation", "((?i)true|false)"), F.lit("false"))) == "true").alias("public_accusation"),
        F.lit(False).alias("parsed"),
    )
    def typed(parsed: Column) -> Column:
        return F.struct(
            F.coalesce(parsed["reply"], F.lit("")).alias("reply"),
            clamp(parsed["suspicion_score"]).alias("suspicion_score"),
            F.coalesce(parsed["reasoning_trace"], F.lit("")).alias("reasoning_trace"),
            F.coalesce(parsed["cues"], F.array().cast("array<string>")).alias("cues"),
            F.coalesce(parsed["trap_strategy"]["plan"], F.lit("")).alias("plan"),
            F.coalesce(parsed["trap_strategy"]["type"], F.lit("none")).alias("trap"),
            F.coalesce(parsed["public_accusation"], F.lit(False)).alias("public_accusation"),
            F.lit(True).alias("parsed"),
        )

    return let(let(unfence(answer), parsed_of), lambda parsed: F.when(parsed.isNotNull(), typed(parsed)).otherwise(found))
