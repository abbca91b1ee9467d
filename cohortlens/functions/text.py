"""Text expressions.  All run inside the JVM; none is a UDF."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from .numeric import let

# Section headers that may stand alone on a line.
SECTION_HEADERS = [
    "Chief Complaint",
    "History of Present Illness",
    "Past Medical History",
    "Social History",
    "Family History",
    "Physical Exam",
    "Pertinent Results",
    "Brief Hospital Course",
    "Medications on Admission",
    "Discharge Medications",
    "Discharge Disposition",
    "Discharge Diagnosis",
    "Discharge Condition",
    "Discharge Instructions",
    "Followup Instructions",
    "Allergies",
    "Attending",
]

# The headers counted as a text statistic are the first 15.
COUNTED_HEADERS = [h.lower() for h in SECTION_HEADERS[:15]]

# Sections removed before cleaning by default.
DEFAULT_REMOVED_SECTIONS = [
    "Discharge Medications",
    "Discharge Disposition",
    "Discharge Diagnosis",
    "Discharge Condition",
]

# Domain stop words added to the English list.
MEDICAL_STOPWORDS = [
    "patient", "pt", "history", "mg", "ml", "dr", "hospital",
    "admission", "discharge", "date", "year", "old", "day",
    "days", "time", "week", "month", "per", "given", "noted",
    "follow", "also", "including", "significant", "without",
    "well", "due", "placed", "started", "continued",
]

# Negation cues.
NEGATION_CUES = [
    "no", "not", "denies", "without", "negative", "absent", "none", "never", "neither", "nor",
]

# What the cleaner blanks out, in order.  (?U) gives the classes
# \d \s \b their Unicode meaning.
CLEANING_PATTERNS = [
    r"_{2,}",
    r"(?U)\[\s*[xX]?\s*\]",
    r"(?U)\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"(?U)\b\d{4}-\d{2}-\d{2}\b",
    r"(?U)\(?\d{3}\)?[\s\-]\d{3}[\s\-]\d{4}",
    r"(?iU)\b\d+\.?\d*\s*(?:mg|ml|mcg|mmol|meq|mm|cm|kg|lb|units?)\b",
]

# White space at both ends, including the ASCII separators.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# A run of letters, two or more, that is all of a whitespace-delimited word once
# punctuation is dropped from its two ends: "a-fib", "10.5", "don't" do not match.
_WORD = r"(?U)(?:^|\s)[^\p{L}\p{N}\s]*(\p{L}{2,})[^\p{L}\p{N}\s]*(?=\s|$)"

# Terms of the weighting vocabulary: two or more word characters.
_TERM = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    # Most texts have none at their ends; the pattern would try every white space.
    ends = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    return _replaced(text, lambda t: F.rlike(ends(t), F.lit(r"(?U)[\s\x1c-\x1f]")), [(_EDGE_SPACE, "")])


def _replaced(text: Column, needed: Callable[[Column], Column], steps: list[tuple[str, str]]) -> Column:
    """Patterns replaced in order, in the texts that pass a cheap test; the test holds
    for every text that one of them matches."""

    def body(t: Column) -> Column:
        out = t
        for pattern, to in steps:
            out = F.regexp_replace(out, pattern, to)
        return F.when(needed(t), out).otherwise(t)

    return let(text, body)


def clean_text(text: Column) -> Column:
    has = lambda *parts: lambda t: reduce(or_, [F.contains(t, F.lit(p)) for p in parts])
    blanked = [(pattern, " ") for pattern in CLEANING_PATTERNS]
    out = F.coalesce(text, F.lit(""))
    out = _replaced(out, has("__"), blanked[:1])
    out = _replaced(out, has("["), blanked[1:2])
    # All others ask for a digit.
    out = _replaced(out, lambda t: F.rlike(t, F.lit(r"(?U)\d")), blanked[2:])
    out = F.lower(out)
    out = _replaced(out, has("  ", "\t"), [(r"[ \t]+", " ")])
    out = _replaced(out, has("\n\n\n"), [(r"\n{3,}", "\n\n")])
    return strip(out)


def _header_pattern(headers: list[str]) -> str:
    names = "|".join(re.escape(h) for h in headers)
    return rf"(?imdU)^({names})\s*:?\s*$"


def sections(text: Column, headers: list[str] | None = None) -> Column:
    """``array<struct<section, body>>`` in text order; blank preamble left out."""
    pattern = _header_pattern(headers or SECTION_HEADERS)
    bodies = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    named = F.zip_with(
        found,
        F.slice(bodies, 2, F.size(found)),
        lambda name, body: F.struct(name.alias("section"), strip(body).alias("body")),
    )
    preamble = F.array(
        F.struct(F.lit("preamble").alias("section"), strip(bodies[0]).alias("body"))
    )
    return F.concat(F.filter(preamble, lambda s: s["body"] != ""), named)


def section_map(text: Column, headers: list[str] | None = None) -> Column:
    """Sections as a map; a header repeated in the same spelling keeps its last body."""
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(
        sections(text, headers),
        empty,
        lambda acc, s: F.map_concat(
            F.map_filter(acc, lambda k, _: k != s["section"]),
            F.create_map(s["section"], s["body"]),
        ),
    )


def remove_sections(text: Column, names: list[str]) -> Column:
    """Drop each named header line with its body, up to the next line made only
    of letters and spaces (read case-insensitively) or the end."""
    any_name = "|".join(map(re.escape, names))
    steps = [
        (rf"(?imsdU)^{re.escape(name)}\s*:?\s*\n(.*?)(?=\n[A-Z][A-Za-z ]+\s*:?\s*\n|\z)", "")
        for name in names
    ]
    return strip(_replaced(text, lambda t: F.rlike(t, F.lit(rf"(?iU){any_name}")), steps))


# The default English stop words that Spark ML publishes.
ENGLISH_STOPWORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom
    this that these those am is are was were be been being have has had having do does did doing
    a an the and but if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some
    such no nor not only own same so than too very s t can will just don should now i'll you'll
    he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
    they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
    doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
    how's let's ought that's there's what's when's where's who's why's would
""".split()


def english_stopwords() -> list[str]:
    return list(ENGLISH_STOPWORDS)


def stopword_set(extra: list[str] | None = None) -> list[str]:
    """Union of the English, the domain and the caller's stop words."""
    return sorted(set(english_stopwords()) | set(MEDICAL_STOPWORDS) | set(extra or []))


def tokenize(text: Column, extra_stopwords: list[str] | None = None) -> Column:
    """Words of two or more letters, lower case, stop words removed.

    One pass of one pattern over the text; the stop word test is a hash lookup
    (``IN`` over literals becomes a set).
    """
    stop = stopword_set(extra_stopwords)
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(stop))


def word_list(text: Column) -> Column:
    """Whitespace words."""
    return F.filter(F.split(strip(text), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_list(text))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """All runs of ``low`` to ``high`` neighbouring words, joined by a space."""
    return let(words, lambda w: _runs(w, low, high))


def _runs(words: Column, low: int, high: int) -> Column:
    count = F.size(words)
    run, out = words, [words]
    for n in range(2, high + 1):
        left = F.greatest(count - (n - 1), F.lit(0))
        run = F.zip_with(
            F.slice(run, 1, left),
            F.slice(words, n, left),
            lambda head, word: F.concat(head, F.lit(" "), word),
        )
        out.append(run)
    chosen = out[low - 1 :]
    return chosen[0] if len(chosen) == 1 else F.concat(*chosen)


def counted(words: Column) -> Column:
    """``array<struct<term, tf>>``: the distinct words with their counts.  Sorted
    once, then cut where the word changes."""

    def cut(w: Column) -> Column:
        n = F.size(w)
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(w, 1, F.greatest(n - 1, F.lit(0))))
        at = F.transform(
            F.zip_with(w, before, lambda a, b: ~a.eqNullSafe(b)), lambda new, i: F.when(new, i)
        )
        return let(
            F.filter(at, lambda i: i.isNotNull()),
            lambda starts: F.zip_with(
                starts,
                F.concat(F.slice(starts, 2, F.size(starts)), F.array(n)),
                lambda a, b: F.struct(F.get(w, a).alias("term"), (b - a).alias("tf")),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return let(
        F.array_sort(words), lambda w: F.when(F.size(w) > 0, cut(w)).otherwise(empty)
    )


def negation_count(text: Column) -> Column:
    cues = "|".join(NEGATION_CUES)
    return F.regexp_count(text, F.lit(rf"(?iU)\b({cues})\b"))


def header_count(text: Column) -> Column:
    lowered = F.lower(text)
    flags = [(F.instr(lowered, h) > 0).cast("int") for h in COUNTED_HEADERS]
    return sum(flags[1:], flags[0])
