"""Predicates: reviews, topical gates, lexical matches, and checks of generated texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import fold_terms, query_terms

#: Patterns of review titles and abstracts, in English and Russian.
REVIEW_TITLE = (
    r"\b(?:review|survey|overview|meta[- ]analysis|bibliometric analysis|systematic mapping|mapping study|"
    r"recent (?:advances|progress|developments)|advances and prospects|progress and perspectives|challenges and progress)\b|"
    r"\b(?:обзор|метаанализ|библиометрическ\w* анализ)\b"
)
REVIEW_ABSTRACT = r"\b(?:this (?:paper|article|study) reviews\b|here,?\s+we (?:critically )?review\b|this review\b)"

#: Requests about ions, and other names of the metals.
ION_REQUEST = r"\b(sodium|lithium|potassium|zinc|magnesium|calcium|alumin(?:um|ium))[\s\-‐‑–]*ion\b"
ION_NAMES = {"sodium": r"(?<!\w)(?:Na[-‐‑– ]?ion|Na\+|SIBs?)(?!\w)", "lithium": r"(?<!\w)(?:Li[-‐‑– ]?ion|Li\+|LIBs?)(?!\w)", "potassium": r"(?<!\w)(?:K[-‐‑– ]?ion|KIBs?)(?!\w)"}

#: Requests about quantum sensing, and its methods.
QUANTUM_REQUEST = r"quantum|квант"
SENSING_REQUEST = r"sens(?:or|ing)|metrolog|датчик|сенсор|измерен"
QUANTUM_METHOD = (
    r"\b(?:quantum|qubit|entangl\w*|squeez\w*|rydberg|spin[ -]?defect\w*|spin resonance|(?:nitrogen|boron)[ -]?vacanc\w*|"
    r"(?:colou?r|NV)[ -]?cent(?:er|re)\w*|atomic (?:sensor\w*|magnetomet\w*|clock\w*)|atom interferomet\w*|SERF)\b"
)

#: Verbs of results.
RESULT_VERB = r"\b(?:demonstrat\w*|show\w*|observ\w*|achiev\w*|measur\w*|result\w*|reduc\w*|improv\w*|показ\w*|получ\w*|измер\w*)\b"
#: Java's classes and word boundaries are ASCII unless told otherwise.
_ANY_CASE = "(?iuU)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _finds(x: Column, pattern: str) -> Column:
    return F.coalesce(x.rlike(_ANY_CASE + pattern), F.lit(False))


def is_review(title: Column, work_type: Column, abstract: Column) -> Column:
    return F.coalesce(F.lower(work_type) == "review", F.lit(False)) | _finds(title, REVIEW_TITLE) | _finds(abstract, REVIEW_ABSTRACT)


def has_quality(abstract: Column, references: Column) -> Column:
    """An abstract and at least one reference."""
    return F.coalesce(abstract.isNotNull() & (F.length(abstract) > 0) & (F.size(references) > 0), F.lit(False))


def valid_query(query: Column) -> Column:
    """At most 200 characters, none a control character."""
    return F.coalesce((F.char_length(query) <= 200) & ~query.rlike(r"[\x00-\x1F\x7F]"), F.lit(False))


def matches_ion(title: Column, abstract: Column, request: str | None) -> Column:
    """If the request names an ion: once in the title or twice in the abstract."""
    found = re.search(ION_REQUEST, request or "", re.I)
    if not found:
        return F.lit(True)
    metal = "aluminum" if found.group(1).lower() == "aluminium" else found.group(1).lower()
    names = [_ANY_CASE + rf"\b{metal}\b"] + (["(?U)" + ION_NAMES[metal]] if metal in ION_NAMES else [])
    hits = lambda x: sum((F.regexp_count(F.coalesce(x, F.lit("")), F.lit(n)) for n in names), F.lit(0))
    return (hits(title) > 0) | (hits(abstract) >= 2)


def matches_quantum_sensing(title: Column, abstract: Column, query: str, request: str | None = None) -> Column:
    """If the request is about quantum sensing: one of its methods in title or abstract."""
    asked = f"{query} {request or ''}"
    if not (re.search(QUANTUM_REQUEST, asked, re.I) and re.search(SENSING_REQUEST, asked, re.I)):
        return F.lit(True)
    return _finds(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit(""))), QUANTUM_METHOD)


def term_hits(text: Column, query: Column) -> Column:
    """How many of the query's terms are in the text. The text's words are first cut to those that
    could fold to one of the terms: words, not terms, of a long text meet a plain lookup."""
    asked = query_terms(query)
    forms = F.array_distinct(F.flatten(F.transform(asked, lambda t: F.array(t, F.concat(t, F.lit("s")), F.concat(F.left(t, F.length(t) - 1), F.lit("ies"))))))
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), F.lit("[a-z][a-z0-9]*"), F.lit(0))
    return F.size(F.array_intersect(asked, fold_terms(F.array_intersect(words, forms))))


def enough_terms(hits: Column, query: Column) -> Column:
    """Whether hits are at least six tenths of the query's terms, and one."""
    n = F.size(query_terms(query))
    return (n > 0) & (hits >= F.greatest(F.lit(1), F.ceil(n * 6 / F.lit(10)).cast("int")))


def matches_query(text: Column, query: Column) -> Column:
    """At least six tenths of the query's terms, and one, are in the text."""
    return enough_terms(term_hits(text, query), query)


def selects_topic(similarity: Column, frequency: Column, seeds: Column) -> Column:
    """Core (similar, covered), niche (very similar, twice) or supported (well covered)."""
    coverage = frequency / seeds
    return ((similarity >= 0.50) & (coverage >= 0.01)) | ((similarity >= 0.65) & (frequency >= 2)) | ((similarity >= 0.30) & (coverage >= 0.05))


def grounded_numbers(result: Column, source: Column) -> Column:
    """Every number of the result is in the source, which is long enough and reports a result."""
    numbers = lambda x: F.regexp_extract_all(F.replace(F.coalesce(x, F.lit("")), F.lit(","), F.lit(".")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    enough = F.coalesce((F.char_length(F.trim(source)) >= 200) & source.rlike(_ANY_CASE + RESULT_VERB), F.lit(False))
    return enough & (F.size(F.array_except(numbers(result), numbers(source))) == 0)


#: Units of measurement that may mix scripts, and marks of a broken text.
UNITS = r"(?<![А-Яа-яЁё])(?:[кмнгдпс]?(?:Гц|Вт|В|А|Па|Дж|Тл|Ом|См|С)|[кМ]?эВ)(?![А-Яа-яЁё])"
BROKEN_CHARACTER = "\ufffd"
BROKEN_SENTENCE = r"[.!?][а-яё]"
BROKEN_SCRIPT = r"[А-Яа-яЁё][A-Za-z]|[A-Za-z][А-Яа-яЁё]"
#: Beginnings of explanations that say nothing about the work.
GENERIC_SIGNALS = ("На оценку статьи положительно повлияли", "Ключевые факторы для этой статьи не выделены.")

_CYRILLIC, _ANY_LETTER = "[А-Яа-яЁё]", "[A-Za-zА-Яа-яЁё]"


def _says_none(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)) == "none", F.lit(True))


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(x) == "", F.lit(True))


def corrupt_text(x: Column, units: str = UNITS) -> Column:
    """Empty, with a broken character, a sentence that goes on in lower case without a space,
    scripts mixed in a word, or a capital inside a word that begins with a small letter."""
    text = F.regexp_replace(F.trim(x), units, "")
    small_first = F.filter(F.regexp_extract_all(text, F.lit("[А-ЯЁа-яё]+"), F.lit(0)), lambda w: w.rlike("^[а-яё]"))
    inner_capital = F.exists(small_first, lambda w: w.rlike("[а-яё][А-ЯЁ]"))
    return _blank(x) | F.coalesce(text.contains(BROKEN_CHARACTER) | text.rlike(BROKEN_SENTENCE) | text.rlike(BROKEN_SCRIPT) | inner_capital, F.lit(False))


def starts_lower_cyrillic(x: Column) -> Column:
    return F.coalesce(F.regexp_extract(x, _ANY_LETTER, 0).rlike("^[а-яё]"), F.lit(False))


def valid_generated(x: Column) -> Column:
    """A text to show: not "None", not corrupt, not beginning in the middle of a sentence."""
    return ~_says_none(x) & ~corrupt_text(x) & ~starts_lower_cyrillic(x)


def valid_description(x: Column, abstract: Column) -> Column:
    """A text to show for an abstract, or "None" where there is no abstract."""
    return F.when(_blank(abstract), _says_none(x)).otherwise(valid_generated(x))


def valid_title(x: Column, source: Column) -> Column:
    """A translated title: a text to show, in Cyrillic if the source has Latin letters, and not
    mostly in Latin words; "None" where there is no source title."""
    latin, cyrillic = (F.regexp_count(F.coalesce(x, F.lit("")), F.lit(p)) for p in ("[A-Za-z]{2,}", f"{_CYRILLIC}{{2,}}"))
    translated = ~F.coalesce(source.rlike("[A-Za-z]"), F.lit(False)) | F.coalesce(x.rlike(_CYRILLIC), F.lit(False))
    return F.when(_blank(source), _says_none(x)).otherwise(valid_generated(x) & translated & ~((latin >= 4) & (latin > cyrillic)))


def valid_signal(x: Column) -> Column:
    """An explanation to show; one of the generic texts is valid but ``generic_signal``."""
    return valid_generated(x)


def generic_signal(x: Column) -> Column:
    """Whether an explanation begins as the generic ones do."""
    text = F.trim(x)
    return F.coalesce(text.startswith(GENERIC_SIGNALS[0]) | text.startswith(GENERIC_SIGNALS[1]), F.lit(False))


def fresh(generated_at: Column, days: int = 1) -> Column:
    """Whether a cached result is at most so many days old."""
    return F.coalesce(F.current_timestamp() - generated_at.cast("timestamp") <= F.expr(f"interval {int(days)} day"), F.lit(False))
