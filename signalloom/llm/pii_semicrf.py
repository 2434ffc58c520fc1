"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field.

The field labels segments, not tokens. Around triggers (digits, spelled-out addresses, titles,
street words) it lists candidate segments of bounded length with every plausible boundary and
type, scores each by features of the whole span, its context and the type of the segment before
it, and a Viterbi pass over the positions chooses boundaries and types jointly (Sarawagi and
Cohen, 2004). Outside the triggers
no segment but "other" exists, so only these islands need the dynamic programme. The weights
maximise the conditional likelihood, by forward-backward over the same segments, of examples
that are generated here from formats with a fixed seed; no corpus is read for them.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, documents
from .spans import FOUND_SQL, Covered, Span, masking_batches, summary_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "iban", "name", "address", "birth")
_RANK = {k: i for i, k in enumerate(KINDS)}
#: Groups (numbers, words) in one segment at most.
LONGEST = 8
#: Characters in one segment of numbers at most.
WIDEST = 62

#: The patterns of the base kinds. Possessive loops and the checks for a run's
#: start only keep long runs linear; they accept the same matches.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, free = [], 0
    for m in _AT.finditer(text):
        a = m.start()
        while a > free and _LOCAL.match(text[a - 1]):
            a -= 1
        if a < m.start():
            found.append((a, m.end(), "email"))
            free = m.end()
    return found


def base_spans(text: str) -> list[Span]:
    """The base kinds: leftmost, non-overlapping within a kind; failing matches are dropped."""
    found = _emails(text) if "@" in text else []
    if not _DIGITS.search(text):
        return found
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub("[ -]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m.group())) <= 15]
    return found


# --- candidate segments -----------------------------------------------------------------

_NUMBERS = re.compile(r"[0-9(][0-9() ./-]{6,}+")
_FIRST = re.compile(r"(?<![\w.+/-])[(]?[0-9]")
_AFTER = re.compile(r"[\w/-]")
_GROUP = re.compile(r"[0-9]+")
_SPELLED = re.compile(r"\b(?:[\w.+-]{1,40}(?: dot | ?\(dot\) ?| ?\[dot\] ?)){0,2}[\w.+-]{1,40}(?: at | ?\(at\) ?| ?\[at\] ?)[\w-]{1,40}(?:(?: dot | ?\(dot\) ?| ?\[dot\] ?|\.)[\w-]{1,20}){1,3}")
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.? (?:(?:[A-Z][a-z]*['\u2019-])*[A-Z][A-Za-z]*\.?(?: (?:de|van|von|der|den|la|le|di|da) (?=[A-Z])| |(?![A-Za-z]))){1,4}")
#: Words that a name without a title follows, and months.
_NAMED = re.compile(r"\b(?:[Mm]y name is|[Nn]ame is|[Nn]ame:|I am|I'm|[Ss]igned by|[Ss]igned:|[Cc]ontact:|[Rr]egards,|[Ss]incerely,)\s{1,3}([A-Z][A-Za-z'\u2019-]*\.?(?: [A-Z][A-Za-z'\u2019-]*\.?){1,3})")
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)"
_DATE = re.compile(rf"\b(?:[0-9]{{1,2}}(?:st|nd|rd|th)? {_MONTH}\.?,? (?:19|20)[0-9]{{2}}|{_MONTH}\.? [0-9]{{1,2}}(?:st|nd|rd|th)?,? (?:19|20)[0-9]{{2}})\b")
_NAME_WORD = re.compile(r"[A-Za-z]+(?:['\u2019-][A-Za-z]+)*")
_STREET = re.compile(r"\b[0-9]{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard)\b")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
#: Words that announce a kind.
CUES = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telephone", "ring", "text", "dial", "whatsapp"),
    "id": ("ssn", "social", "security", "passport", "taxpayer", "tax", "insurance", "identity", "nin", "nhs", "patient"),
    "birth": ("born", "birth", "dob", "birthday"),
    "other": ("order", "isbn", "version", "page", "pages", "price", "invoice", "serial", "issue", "vol", "between", "part", "chapter"),
}
_CUE = {w: kind for kind, ws in CUES.items() for w in ws}
_WORD = re.compile(r"[A-Za-z]+")


def mod97(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def number_runs(text: str) -> list[tuple[int, int]]:
    """Runs (start, end) of numbers of any length, that no word or sign goes on; in linear time."""
    out = []
    for m in _NUMBERS.finditer(text):
        first, end = _FIRST.search(text, m.start(), m.end()), m.end()
        if not first:
            continue
        while end > first.start() and not (text[end - 1].isascii() and text[end - 1].isdigit() and not _AFTER.match(text, end)):
            end -= 1
        if end - first.end() >= 6:
            out.append((first.start(), end))
    return out


def islands(text: str) -> list[list[tuple[int, int, str]]]:
    """Lists of candidate segments (start, end, kind); segments of different lists never overlap."""
    every: list[tuple[int, int, str]] = []
    if _DIGITS.search(text):
        for start, end in number_runs(text):
            groups = [g.span() for g in _GROUP.finditer(text, start, end)]
            for i in range(len(groups)):
                for j in range(i, min(i + LONGEST, len(groups))):
                    a, b = groups[i][0], groups[j][1]
                    n = sum(y - x for x, y in groups[i : j + 1])
                    if a and text[a - 1] == "(" and ")" in text[a:b]:
                        a -= 1
                    if 6 <= n <= 15 and b - a <= WIDEST:
                        every += [(a, b, kind) for kind in ("phone", "id", "birth")[: 3 if j - i == 2 or j == i else 2 if j - i < 4 else 1]]
        every += [(m.start(), m.end(), "birth") for m in _DATE.finditer(text)]
        every += [(m.start(), m.end(), "address") for m in _STREET.finditer(text)]
        every += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text)]
    if "dot" in text or "(at)" in text or "[at]" in text:
        every += [(m.start(), m.end(), "email") for m in _SPELLED.finditer(text)]
    if "Mr" in text or "Ms" in text or "Miss" in text or "Dr" in text or "Prof" in text:
        for m in _TITLE.finditer(text):
            ends = [m.start() + w.end() for w in _NAME_WORD.finditer(m.group())]
            every += [(m.start(), e, "name") for e in ends[1 : LONGEST + 1]]
    for m in _NAMED.finditer(text):
        ends = [m.start(1) + w.end() for w in _NAME_WORD.finditer(m.group(1))]
        every += [(m.start(1), e, "name") for e in ends[1:LONGEST]]
    every.sort()
    out: list[list[tuple[int, int, str]]] = []
    end = -1
    for s in every:
        if s[0] < end and out:
            out[-1].append(s)
        else:
            out.append([s])
        end = max(end, s[1])
    return out


#: Characters on each side in which a run of numbers is looked at.
BESIDE = 24
_BEFORE, _BEHIND = re.compile(r"[0-9() ./,-]*\Z"), re.compile(r"[0-9() ./,-]*")


def beside(text: str, a: int, b: int) -> tuple[str, str]:
    """How many more numbers stand before and after a segment in one run: 0, 1, 2, 3 or more."""
    return _numbers(text[max(0, a - BESIDE) : a], True), _numbers(text[b : b + BESIDE], False)


@lru_cache(maxsize=4096)
def _numbers(x: str, before: bool) -> str:
    run = _BEFORE.search(x).group() if before else _BEHIND.match(x).group()
    return str(min(len(_GROUP.findall(run)), 3))


@lru_cache(maxsize=4096)
def _facts(span: str, left: str, right: str) -> tuple[list[str], list[str], str, str]:
    """Features of a segment that are the same for every type, its numbers, their shape and the cue."""
    digits = _GROUP.findall(span)
    shape = "-".join(str(len(g)) for g in digits[:6])
    seps = "".join(sorted({c for c in span if not (c.isalnum() or c == "_")}))
    words = [w.lower() for w in _WORD.findall(left)]
    cue = next((_CUE[w] for w in reversed(words[-4:]) if w in _CUE), "none")
    f = [f"digits={sum(map(len, digits))}", f"shape={shape}", f"seps={seps}", f"cue={cue}", f"groups={min(len(digits), 6)}", f"words={len(_WORD.findall(span))}"]
    f.append(f"left={'d' if left[-2:].strip()[-1:].isdigit() else 'o'}")
    f.append(f"right={'d' if right.strip()[:1].isdigit() else 'o'}")
    f.append(f"shape+cue={shape}/{cue}")
    return f, digits, shape, cue


def features(text: str, a: int, b: int, kind: str) -> list[str]:
    """Features of a whole segment and what stands around it, each joined with its type."""
    span = text[a:b]
    common, digits, shape, cue = _facts(span, text[max(0, a - 32) : a], text[b : b + 2])
    f = list(common)
    if kind in ("phone", "id", "birth"):
        before, after = beside(text, a, b)
        f += [f"before={before}", f"after={after}", f"beside+cue={max(before, after)}/{cue}"]
    elif kind == "name":
        f.append(f"title={bool(_TITLE.match(text, a))}")
    if kind == "id":
        f.append(f"valid={shape == '3-2-4' and digits[0] not in ('000', '666') and digits[0][0] != '9' and digits[1] != '00' and digits[2] != '0000'}")
    elif kind == "birth":
        day = [int(x) for x in digits[:3]] if len(digits) == 3 else [0, 0, 0]
        spelled = bool(_DATE.fullmatch(span))
        f.append(f"valid={spelled or (any(1 <= x <= 12 for x in day[:2]) and all(x for x in day) and any(1900 <= x <= 2030 for x in day))}")
        f.append(f"spelled={spelled}/{cue}")
    elif kind == "iban":
        f.append(f"valid={mod97(span)}")
    elif kind == "email":
        f.append(f"valid={bool(re.search(r'dot|[\[(]at[\])]', span)) and span.rsplit(None, 1)[-1].isalpha()}")
    return [f"{kind}|{x}" for x in f] + [f"{kind}|"]


# --- the field ----------------------------------------------------------------------------


Links = dict[tuple[str, str], float]
_NO_LINKS: Links = {}


def _lattice(segments: list[tuple[int, int, str]]) -> tuple[list[str], list[tuple[int, int, int]], int]:
    """The types, "" for none before; each segment as (first point, last point, type); the points' number."""
    points = sorted({p for a, b, _ in segments for p in (a, b)})
    at = {p: i for i, p in enumerate(points)}
    kinds = ["", *sorted({k for _, _, k in segments})]
    return kinds, [(at[a], at[b], kinds.index(k)) for a, b, k in segments], len(points)


def _paths(segments: list[tuple[int, int, str]], scores: list[float], links: Links):
    """What the two passes share: segments by their last point, and a link's score by type numbers."""
    kinds, placed, n = _lattice(segments)
    into: list[list[int]] = [[] for _ in range(n)]
    for i, (_, b, _) in enumerate(placed):
        into[b].append(i)
    table = [[links.get((x, y), 0.0) for y in kinds] for x in kinds]
    return kinds, placed, n, into, table


def viterbi(segments: list[tuple[int, int, str]], scores: list[float], links: Links = _NO_LINKS) -> list[int]:
    """The best set of segments that don't overlap; what none covers is "other", of score 0. ``links``
    are scores of a segment's type after the type of the one before it."""
    kinds, placed, n, into, table = _paths(segments, scores, links)
    best = [[-math.inf] * len(kinds) for _ in range(n)]
    taken: list[list[tuple[int, int] | None]] = [[None] * len(kinds) for _ in range(n)]
    best[0][0] = 0.0
    for p in range(1, n):
        best[p] = best[p - 1][:]
        for i in into[p]:
            a, _, k = placed[i]
            before = max(range(len(kinds)), key=lambda j: best[a][j] + table[j][k])
            score = best[a][before] + table[before][k] + scores[i]
            if score > best[p][k]:
                best[p][k], taken[p][k] = score, (i, before)
    k = max(range(len(kinds)), key=best[-1].__getitem__)
    out, p = [], n - 1
    while p > 0 and k:
        while p > 0 and best[p][k] == best[p - 1][k] and taken[p][k] is None:
            p -= 1
        i, k = taken[p][k]
        out.append(i)
        p = placed[i][0]
    return out[::-1]


def _add(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > -math.inf else max(x, y)


def marginals(segments: list[tuple[int, int, str]], scores: list[float], links: Links = _NO_LINKS) -> tuple[list[float], dict[tuple[str, str], float]]:
    """Each segment's probability and each link's expected number, by forward-backward over the
    points where segments begin or end and the type of the last segment."""
    kinds, placed, n, into, table = _paths(segments, scores, links)
    size = len(kinds)
    forward = [[-math.inf] * size for _ in range(n)]
    backward = [[0.0] * size for _ in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for i, (a, _, _) in enumerate(placed):
        out[a].append(i)
    forward[0][0] = 0.0
    for p in range(1, n):
        forward[p] = forward[p - 1][:]
        for i in into[p]:
            a, _, k = placed[i]
            for j in range(size):
                forward[p][k] = _add(forward[p][k], forward[a][j] + table[j][k] + scores[i])
    for p in range(n - 2, -1, -1):
        backward[p] = backward[p + 1][:]
        for i in out[p]:
            _, b, k = placed[i]
            for j in range(size):
                backward[p][j] = _add(backward[p][j], table[j][k] + scores[i] + backward[b][k])
    total = backward[0][0]
    chances, expected = [], defaultdict(float)
    for i, (a, b, k) in enumerate(placed):
        each = [math.exp(forward[a][j] + table[j][k] + scores[i] + backward[b][k] - total) for j in range(size)]
        chances.append(sum(each))
        for j, x in enumerate(each):
            expected[kinds[j], kinds[k]] += x
    return chances, expected


def examples(n: int = 2400, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Generated sentences with their true spans; half of them have numbers that are nobody's."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choice(("ta", "lin", "or", "me", "sh", "an", "ver", "do")) for _ in range(rng.randint(1, 3)))
    name = lambda: word().capitalize()
    months = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Jan", "Feb", "Aug", "Sept", "Oct", "Dec")
    birth = lambda: rng.choice((f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1930, 2015)}", f"{rng.randint(1930, 2015)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28)} {rng.choice(months)} {rng.randint(1930, 2015)}", f"{rng.choice(months)} {rng.randint(1, 28)}, {rng.randint(1930, 2015)}"))

    def column() -> str:
        """A row of a table: numbers of one shape, or of several."""
        widths, sep = [rng.randint(1, 7) for _ in range(rng.choice((1, 1, 2, 3)))], rng.choice((" ", " ", "  ", " - ", ", "))
        return sep.join(num(widths[k % len(widths)]) for k in range(rng.randint(4, 24)))

    def iban() -> str:
        body = num(rng.choice((14, 18)))
        country = rng.choice(("DE", "FR", "ES", "GB"))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check:02}{body}"
        return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def ssn() -> str:
        return f"{rng.randint(1, 665):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}"

    def phone() -> str:
        return rng.choice((f"{num(3)}-{num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"07{num(3)} {num(6)}", f"0{num(3)} {num(6)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(2)}/{num(7)}", f"00{num(2)} {num(2)} {num(rng.randint(5, 7))}", f"00{num(2)} {num(3)} {num(3)} {num(4)}"))

    def announced(kind: str, made: str) -> tuple[str, str]:
        before = {"phone": (*(f"{c}{x}" for c in CUES["phone"] for x in (" ", ": ", " me on ")), "reach us at "), "id": ("SSN ", "SSN: ", "social security number ")}[kind]
        return rng.choice(before) if rng.random() < 0.7 else "", made

    def person() -> str:
        last = rng.choice((name(), f"{rng.choice(('O', 'D'))}'{name()}", f"Mc{name()}", f"{name()}-{name()}", f"{rng.choice(('van', 'de', 'von'))} {name()}"))
        first = rng.choice(("", f"{name()} ", f"{name()} ", f"{name()[0]}. ", f"{name()} {name()[0]}. "))
        return f"{rng.choice(('Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Prof.', 'Mr', 'Ms', 'Miss'))} {first}{last}"

    def spelled() -> str:
        local = word() if rng.random() < 0.6 else f"{word()} dot {word()}"
        if rng.random() < 0.6:
            return f"{local} at {word()} dot {rng.choice(('com', 'org', 'net', 'co dot uk'))}"
        return f"{word()}{rng.choice(('(at)', '[at]', ' (at) ', ' [at] '))}{word()}{rng.choice(('.', ' dot ', ' [dot] '))}{rng.choice(('com', 'org'))}"

    makers = {
        "phone": lambda: announced("phone", phone()),
        "id": lambda: announced("id", ssn()) if rng.random() < 0.5 else (rng.choice(("NHS number ", "NHS no. ", "patient number ")), rng.choice((f"{num(3)} {num(3)} {num(4)}", num(10)))) if rng.random() < 0.3 else (rng.choice(("passport no ", "passport number ", "passport ", "tax id ", "national insurance no ", "identity card ", "taxpayer number ")), num(rng.randint(8, 11))),
        "birth": lambda: (rng.choice(("born ", "born on ", "date of birth: ", "DOB ")), birth()),
        "iban": lambda: ("IBAN " if rng.random() < 0.5 else "", iban()),
        "email": lambda: ("", spelled()),
        "name": lambda: ("", person()) if rng.random() < 0.7 else (rng.choice(("my name is ", "My name is ", "name: ", "I am ", "signed by ", "Signed: ", "Regards, ", "contact: ")), f"{name()} {rng.choice((name(), f'{name()}-{name()}', f'{name()[0]}. {name()}', f'Mc{name()}'))}"),
        "address": lambda: ("", f"{rng.randint(1, 999)} {name()} {rng.choice(('Street', 'Avenue', 'Road', 'Lane'))}"),
    }
    nobody = (
        lambda: f"{rng.choice(CUES['other'])} {num(rng.randint(6, 15))}",
        lambda: f"{rng.randint(1900, 2024)}-{rng.randint(1900, 2024)}",
        lambda: f"{rng.choice(('', 'on ', 'dated '))}{birth()}",
        lambda: f"isbn {num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
        lambda: f"{num(2)}.{num(2)}.{num(2)}.{num(2)}",
        lambda: f"pages {num(3)}-{num(3)} and {num(4)}",
        lambda: num(rng.randint(7, 15)),
        lambda: f"{num(4)} {num(4)} {num(4)} {num(3)}",
        lambda: f"{num(1)}.{num(2)} - {num(1)}.{num(3)} {num(2)}",
        lambda: f"{word()} at {word()} dot {word()}s",
        lambda: f"{rng.choice(('order', 'part', 'serial'))} {num(3)}-{num(2)}-{num(4)}",
        lambda: f"{num(3)} {num(3)} {num(4)}",
        lambda: f"ZZ{num(2)}{num(14)}",
        column,
        column,
        lambda: f"name: {name()}",
    )
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(1, 4))) + " ", []
        for _ in range(rng.randint(1, 2)):
            if rng.random() < 0.5:
                kind = rng.choice(list(makers))
                for k in range(rng.choice((1, 1, 1, 2, 3))):  # sometimes a row of them
                    before, body = makers[kind]()
                    text += (rng.choice((", ", " ", " / ")) if kind == "phone" else ", ") if k else before
                    spans.append((len(text), len(text) + len(body), kind))
                    text += body
            else:
                text += rng.choice(nobody)()
            text += rng.choice((" ", ", ", ". ")) + " ".join(word() for _ in range(rng.randint(1, 5))) + " "
        out.append((text, spans))
    return out


class Field:
    """``weights`` of features, and scores of ``links``: a type after the type of the segment before."""

    def __init__(self, weights: dict[str, float], links: Links) -> None:
        self.weights, self.links = weights, links

    def scores(self, text: str, segments: list[tuple[int, int, str]], margin: float = 0.0) -> list[float]:
        return [sum(self.weights.get(x, 0.0) for x in features(text, *s)) - margin for s in segments]


def train(data: list[tuple[str, list[Span]]], epochs: int = 6, rate: float = 0.4, decay: float = 1e-4) -> Field:
    """Weights of greatest regularised conditional likelihood, by stochastic gradient (AdaGrad)."""
    weights: dict = defaultdict(float)
    seen: dict = defaultdict(lambda: 1e-6)
    cases = []
    for text, spans in data:
        truth = set(spans)
        for segments in islands(text):
            true = [s in truth for s in segments]
            row = ["", *(k for (_, _, k), t in sorted(zip(segments, true)) if t)]
            cases.append((segments, [features(text, *s) for s in segments], true, list(zip(row, row[1:]))))
    rng = random.Random(5)
    for _ in range(epochs):
        rng.shuffle(cases)
        for segments, fs, true, pairs in cases:
            chances, expected = marginals(segments, [sum(weights[x] for x in f) for f in fs], weights)
            step: dict = defaultdict(float)
            for f, p, t in zip(fs, chances, true):
                for x in f:
                    step[x] += t - p
            for pair in pairs:
                step[pair] += 1
            for pair, x in expected.items():
                step[pair] -= x
            for x, g in step.items():
                g -= decay * weights[x]
                seen[x] += g * g
                weights[x] += rate * g / math.sqrt(seen[x])
    return Field({x: w for x, w in weights.items() if isinstance(x, str)}, {x: w for x, w in weights.items() if isinstance(x, tuple)})


@lru_cache(maxsize=1)
def trained() -> Field:
    return train(examples())


def _finder(field: Field, margin: float):
    def find(text: str) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        covered, added = Covered(base), []
        for segments in islands(text):
            segments = [s for s in segments if not covered.overlaps(s)]
            if segments:
                added += [segments[i] for i in viterbi(segments, field.scores(text, segments, margin), field.links)]
        return base, added

    return find


def _order(span: Span) -> tuple:
    return _RANK[span[2]], span[0], span[1]


#: What a segment's score must exceed that of "other" by: fewer false alarms than likelihood alone.
MARGIN = 1.0


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found.

    The counts and base_sha256 are of the base kinds' patterns; ``found`` lists all spans as
    (kind, start, end), ``spans`` the same as text, in code points. Null and empty texts have
    none. Repeated rows each return a row, a null doc_id stays null, other columns are ignored,
    an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return arrow_map(rows, summary_batches(_finder(trained(), margin), KINDS, BASE, _order), f"doc_id long, {counts}, base_sha256 string, spans string, found {FOUND_SQL}")


def mask(docs: DataFrame, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets; all rows and columns
    stay. Null and empty texts stay as they are; an empty table stays one."""
    return arrow_map(docs, masking_batches(_finder(trained(), margin), text_col, lambda kind: f"[{kind.upper()}]"), docs.schema)


def op1_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir)).drop("found")


QUERIES = {"op1_pii_semicrf": op1_pii_semicrf}
ORACLE_SQL: dict[str, str] = {}
