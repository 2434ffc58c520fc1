"""Languages of texts, and the spans of mixed-language texts.

Words lie between white space and between scripts; in scripts without spaces each letter is one.
A word's script, from ranges of code points, narrows the languages to those that write in it;
among them the word is scored by its character trigrams. Viterbi over the words, with a penalty
for switching, gives each word a language. Running sums show most texts' path without the
programme: if no stretch of another language gains more than the penalty over the best single
one, a path with both loses, as each other stretch costs a switch; and if the others' best words
together gain nothing, so does a path without it. All other texts go through the programme. The
model is learned from a bounded sample of the labelled documents that are not held out.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, documents, materialise, values

FOLDS = 5
#: Documents that the model is learned from at most, dealt evenly to languages and chosen by a hash.
SAMPLE = 6000
#: Trigrams kept, by count.
TRIGRAMS = 60_000
#: Nats by which one word can speak against a language, that a switch costs, and by which a word
#: speaks against a language that is not written in its script.
WORD_LIMIT, SWITCH, SCRIPT_LIMIT = 6.0, 10.0, 15.0
#: Share of a language's letters from which a script counts as its own.
SCRIPT_SHARE = 0.01
_CACHE_WORDS = 400_000
#: Characters of texts whose words are held at once, or one text.
_TOGETHER = 1 << 20

#: First code points of script ranges (Unicode blocks), to the next one.
_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
_STARTS = [a for a, _ in _RANGES]


def script(char: str) -> str:
    return _RANGES[bisect_right(_STARTS, ord(char)) - 1][1]


#: Scripts that are written without spaces: each letter is a word.
UNSPACED = frozenset(("han", "kana", "thai"))


@lru_cache(maxsize=200_000)
def cuts(token: str) -> tuple[int, ...]:
    """Where a token without white space is cut into words: before a letter of another script than
    the one before it, and before each letter of an unspaced script but a word's first."""
    out, last = [], None
    for i, c in enumerate(token):
        if c.isalpha():
            kind = script(c)
            if last is not None and (kind != last or kind in UNSPACED):
                out.append(i)
            last = kind
    return tuple(out)


def pieces(token: str) -> list[str]:
    at = cuts(token)
    return [token[a:b] for a, b in zip((0, *at), (*at, len(token)))] if at else [token]


#: A character that may be a letter of another script than Latin.
_BEYOND_LATIN = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u2070-\u209f\u20d0-\U0010ffff]")


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text: between white space, of one script each."""
    low = text.lower()
    tokens = low.split()
    if not _BEYOND_LATIN.search(low):
        return tokens
    return [w for t in tokens for w in ((t,) if t.isascii() else pieces(t))]


def letters(token: str) -> str:
    return token if token.isalpha() else "".join(c for c in token if c.isalpha())


def trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


class Model:
    """``languages``, the scripts of each, and log probabilities of trigrams by language."""

    def __init__(self, languages: list[str], scripts: dict[str, list[bool]], rows: dict[str, int], logs: np.ndarray) -> None:
        self.languages, self.scripts, self.rows, self.logs = languages, scripts, rows, logs
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.languages)))
        self.sizes = np.zeros(1024, np.int64)
        self.judged = np.zeros(1024, np.int64)

    def learn(self, tokens: set[str]) -> None:
        """Score new tokens, all at once: log likelihoods by language, 0 for the best and bounded
        below, lower where a language has not their script; all 0 for a token without letters or in a script that no language is known to use."""
        if len(self.known) > _CACHE_WORDS:
            self._forget()
        fresh = [(t, letters(t)) for t in sorted(tokens.difference(self.known))]
        if not fresh:
            return
        first, n = len(self.known), len(fresh)
        while first + n > len(self.sizes):
            self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
            self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
            self.judged = np.concatenate((self.judged, np.zeros_like(self.judged)))
        self.known.update((t, first + i) for i, (t, _) in enumerate(fresh))
        self.sizes[first : first + n] = [len(w) for _, w in fresh]
        scored = [(first + i, w, own) for i, (_, w) in enumerate(fresh) if w and (own := self.scripts.get(script(w[0]))) and any(own)]
        if not scored:
            return
        get, unseen = self.rows.get, len(self.logs) - 1
        flat = np.array([get(t, unseen) for _, w, _ in scored for t in trigrams(w)], np.int64)
        # a word of n letters has n trigrams
        starts = np.cumsum([0] + [len(w) for _, w, _ in scored[:-1]])
        s = np.add.reduceat(self.logs[flat], starts, axis=0)
        s = np.where([own for _, _, own in scored], s, -np.inf)
        self.judged[[k for k, _, _ in scored]] = [len(w) for _, w, _ in scored]
        bounded = np.maximum(s - s.max(axis=1, keepdims=True), -WORD_LIMIT)
        self.scores[[k for k, _, _ in scored]] = np.where(np.isneginf(s), -SCRIPT_LIMIT, bounded)

    def letters_of(self, tokens: list[str]) -> tuple[int, np.ndarray]:
        """The letters of all tokens, and of each those that speak for some language."""
        at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        return int(self.sizes[at].sum()), self.judged[at]

    def path(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The language by number and the letters of each of the tokens, which were learned before."""
        at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        scores, sizes = self.scores[at], self.sizes[at]
        best = int(scores.sum(axis=0).argmax())
        more = scores - scores[:, best : best + 1]
        gain = np.cumsum(more, axis=0)
        rise = gain - np.minimum(np.minimum.accumulate(gain, axis=0), 0)
        if rise.max(initial=0) <= SWITCH and np.delete(more, best, axis=1).max(axis=1, initial=-WORD_LIMIT).sum() <= 0:
            return np.full(len(tokens), best), sizes
        return viterbi(scores, SWITCH), sizes


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The labels of greatest total score less ``switch`` for each change; ties stay, then take the first."""
    n, k = scores.shape
    total = scores[0].tolist()
    back = []
    for row in scores[1:].tolist():
        top = max(range(k), key=total.__getitem__)
        least = total[top] - switch
        back.append([j if total[j] >= least else top for j in range(k)])
        total = [x + (t if t >= least else least) for x, t in zip(row, total)]
    j = max(range(k), key=total.__getitem__)
    out = [j]
    for b in reversed(back):
        j = b[j]
        out.append(j)
    return np.array(out[::-1], np.int64)


def word_letters(token: str) -> tuple[str, str] | None:
    """The letters of a token and the script of the first; None without letters."""
    word = letters(token)
    return (word, script(word[0])) if word else None


#: The weight of a word's trigrams, in whole parts, so that sums don't depend on their order.
UNIT = 1_000_000


def word_weight(n: int) -> int:
    """A word counts by the logarithm of its number: a copied page should not speak for its language."""
    return round(UNIT * (1 + math.log(n)))


def assembled(languages: list[str], trigram_rows: list[tuple[str, list[int]]], script_rows: list[tuple[str, str, int]]) -> Model:
    """A model from the kept trigrams' weights by language, and letters by language and script."""
    table = np.array([w for _, w in trigram_rows] + [[0] * len(languages)], float).reshape(-1, len(languages)) / UNIT + 0.5
    written: dict[str, np.ndarray] = {}
    for lang, kind, n in script_rows:
        written.setdefault(kind, np.zeros(len(languages)))[languages.index(lang)] += n
    total = sum(written.values(), np.zeros(len(languages)))
    scripts = {s: [bool(x) for x in w >= SCRIPT_SHARE * np.maximum(total, 1)] for s, w in written.items()}
    return Model(languages, scripts, {t: i for i, (t, _) in enumerate(trigram_rows)}, np.log(table / table.sum(axis=0)))


def learn(pairs: Iterator[tuple[str, str]]) -> Model:
    """A model from (text, language) pairs: what ``train`` does in the tasks, for a few texts."""
    words: dict[str, Counter] = defaultdict(Counter)
    for text, lang in pairs:
        words[lang].update(words_of(text))
    languages = sorted(words)
    if not languages:
        return Model([], {}, {}, np.zeros((1, 0)))
    weights: dict[str, list[int]] = {}
    script_rows = []
    for j, lang in enumerate(languages):
        for token, n in words[lang].items():
            if found := word_letters(token):
                script_rows.append((lang, found[1], n * len(found[0])))
                for t in trigrams(found[0]):
                    weights.setdefault(t, [0] * len(languages))[j] += word_weight(n)
    top = sorted(weights, key=lambda t: (-sum(weights[t]), t.encode()))[:TRIGRAMS]
    return assembled(languages, [(t, weights[t]) for t in top], script_rows)


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each language's texts have each token; summed within a batch."""
    for batch in batches:
        counts: Counter = Counter()
        for text, lang in zip(values(batch.column("text")), batch.column("lang").to_pylist()):
            counts.update((lang, t) for t in words_of(text))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "token", "n"])


def _trigram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, what, n): weights of trigrams and letters of scripts; summed within a batch."""
    for batch in batches:
        sums: Counter = Counter()
        for lang, token, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "token", "n"))):
            if found := word_letters(token):
                sums[lang, "script", found[1]] += n * len(found[0])
                for t in trigrams(found[0]):
                    sums[lang, "trigram", t] += word_weight(n)
        columns = [pa.array([k[i] for k in sums], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(sums.values()), pa.int64())], names=["lang", "kind", "what", "n"])


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def quotas(counts: dict[str, int], sample: int) -> dict[str, int]:
    """Rows by language: an even share of the sample, what small languages leave going to the others,
    and one at least."""
    out, left = {}, sample
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(left // (len(counts) - k), 1))
        left -= out[lang]
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` rows with a language that are not held out (doc_id, text, lang),
    or one for each language if there are more of those. The rows are dealt evenly to languages.
    The driver gets the weights of the kept trigrams, never texts. Rows without doc_id, text or
    lang are left out; of rows equal in id and text one counts; an empty table teaches nothing."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("hash"), "text", "lang")
    # the order is decided without the texts; only those of the sample move
    keys = rows.groupBy("doc_id", "hash").agg(F.min("lang").alias("lang"))
    counts = {r.lang: r["count"] for r in keys.groupBy("lang").count().toLocalIterator()}
    if not counts:
        return Model([], {}, {}, np.zeros((1, 0)))
    takes = quotas(counts, sample)
    # a uniform hash leaves few more rows than are taken, so that ranking them is a small step
    place = F.pmod(F.xxhash64("doc_id", "hash", F.lit(10)), F.lit(1 << 30)) / (1 << 30)
    bounds = [{"lang": x, "take": n, "below": min(1.0, (n + 6 * math.sqrt(n) + 20) / counts[x])} for x, n in takes.items()]
    limits = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(bounds)), "array<struct<lang: string, take: int, below: double>>")))
    few = keys.join(F.broadcast(limits), "lang").withColumn("place", place).where(F.col("place") < F.col("below"))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "hash")))
    chosen = ranked.where(F.col("rank") <= F.col("take")).select("doc_id", "hash")
    found = rows.join(F.broadcast(chosen), ["doc_id", "hash"]).groupBy("doc_id", "hash").agg(F.min(F.struct("lang", "text")).alias("x")).select("x.lang", "x.text")
    tokens = arrow_map(found, _token_batches, "lang string, token string, n long").groupBy("lang", "token").agg(F.sum("n").alias("n"))
    parts = materialise(arrow_map(tokens, _trigram_batches, "lang string, kind string, what string, n long").groupBy("lang", "kind", "what").agg(F.sum("n").alias("n")), "trigrams")
    languages = sorted(takes)
    weight = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"w{j}") for j, x in enumerate(languages)]
    top = parts.where("kind = 'trigram'").groupBy(F.col("what")).agg(F.sum("n").alias("n"), *weight).orderBy(F.desc("n"), "what").limit(TRIGRAMS).collect()
    scripts = parts.where("kind = 'script'").collect()
    return assembled(languages, [(r.what, [r[f"w{j}"] for j in range(len(languages))]) for r in top], [(r.lang, r.what, r.n) for r in scripts])


def summaries(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language of most letters that speak for some language, their share of all letters) of each text."""
    lists = [words_of(t or "") for t in texts]
    if model.languages:
        model.learn(set().union(*lists))
    out = []
    for tokens in lists:
        if not tokens or not model.languages:
            out.append(("und", 0.0))
            continue
        total, judged = model.letters_of(tokens)
        if not total:
            out.append(("und", 0.0))
            continue
        by = np.bincount(model.path(tokens)[0], weights=judged, minlength=len(model.languages))
        k = int(by.argmax())
        out.append((model.languages[k], round(float(by[k] / total), 6)))
    return out


def _predict_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held, size = [], [], 0
            for text in values(batch.column("text")):
                if held and (len(held) == 256 or size + len(text or "") > _TOGETHER):
                    found += summaries(model, held)
                    held, size = [], 0
                held.append(text)
                size += len(text or "")
            if held:
                found += summaries(model, held)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    lang_pred is the language of most letters, score their share of all letters; letters of a
    script that no learned language is written in speak for none, so a text of them alone gets
    the first language with score 0. Null text, text without a letter, and any text if nothing
    was learned give ``und`` and 0. Repeated rows each return a
    row; a null doc_id stays null and is not held out; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return arrow_map(rows, _predict_batches(model), "doc_id long, held_out boolean, lang_pred string, score double")


def text_spans(model: Model, text: str | None) -> list[tuple[int, int, str]]:
    """Maximal spans (start, end, language) of words of one language, in code points."""
    places, tokens, at = [], [], 0
    for token in (text or "").split():
        at = text.index(token, at)
        edges = (0, *cuts(token), len(token))
        for a, b in zip(edges, edges[1:]):
            places.append((at + a, at + b))
            tokens.append(token[a:b].lower())
        at += len(token)
    if not tokens or not model.languages:
        return []
    model.learn(set(tokens))
    out: list[list] = []
    for (a, b), k, n in zip(places, *model.path(tokens)):
        if out and (not n or out[-1][2] == model.languages[k]):
            out[-1][1] = b
        elif n:
            out.append([a, b, model.languages[k]])
    return [tuple(x) for x in out]


def _span_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            found = [[{"start": a, "end": b, "lang": x} for a, b, x in text_spans(model, t)] for t in values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return run


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of (start, end, lang)) for each row; none where there is no word with a
    letter, so none for null and empty texts. Repeated rows each return a row, a null doc_id stays
    null, other columns are ignored, an empty table gives no rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, _span_batches(model), "doc_id long, spans array<struct<start: int, end: int, lang: string>>")


def op10_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, train(docs))


QUERIES = {"op10_language_viterbi": op10_language_viterbi}
ORACLE_SQL: dict[str, str] = {}
