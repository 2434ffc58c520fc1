"""Secrets in texts: fixed patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary writes words in few tokens and random strings in many. A long unbroken
run of key characters whose characters per token fall below a limit is taken for a secret,
unless it is a digest of a known length, a UUID, or an identifier made of words and numbers:
words by the same test, each by itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, documents
from .packing_dp import VOCABULARY, encoder
from .spans import FOUND_SQL, Covered, Span, masking_batches, summary_batches

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
_RANK = {k: i for i, k in enumerate(KINDS)}

#: The patterns of the base kinds.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of at least 32: the same as all runs with the shorter ones dropped.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

#: Characters of a run that the token test looks at, at least, and of one that has the form of words
#: and numbers: below, invented words and names take as many tokens as random strings.
LEAST, LEAST_WORDS = 16, 20
_SIGNS = "!#$%&*@^~+/_=-"
_RUN = re.compile(r"(?<![A-Za-z0-9!#$%&*@^~+/_=-])[A-Za-z0-9!#$%&*@^~+/_=-]{16,}")
#: Hex digits of common digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_DIGITS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words of letters, at most capitalised, or whole numbers, joined by signs.
_IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]++|[A-Z]++|(?<![A-Za-z])[0-9]++|[!#$%&*@^~+/_=-])++")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Characters per token below which a run is taken for random. Random letters and digits give about 1.5.
LIMIT = 2.1


def base_secrets(text: str) -> list[Span]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def known_form(run: str, limit: float = LIMIT, vocabulary: str = VOCABULARY) -> bool:
    """A digest, a UUID, a run without letters, or an identifier: words and whole numbers, where the
    words take few tokens each by itself."""
    if len(run) in DIGEST_DIGITS and _DIGEST.fullmatch(run) or _UUID.fullmatch(run):
        return True
    words = _WORD.findall(run)
    if not words:
        return True
    if not _IDENTIFIER.fullmatch(run):
        return False
    if len(run) < LEAST_WORDS:
        return True
    encode = encoder(vocabulary).fast.encode_ordinary
    return sum(map(len, words)) >= limit * sum(len(encode(w)) for w in words)


def random_strings(text: str, base: list[Span], limit: float = LIMIT, vocabulary: str = VOCABULARY) -> list[Span]:
    covered, found = Covered(base), []
    for m in _RUN.finditer(text):
        run = m.group().strip(_SIGNS)
        a = m.start() + m.group().index(run) if run else m.start()
        span = (a, a + len(run), "random")
        if len(run) < LEAST or known_form(run, limit, vocabulary) or covered.overlaps(span):
            continue
        if len(run) < limit * len(encoder(vocabulary).fast.encode_ordinary(run)):
            found.append(span)
    return found


def _finder(limit: float, vocabulary: str):
    def find(text: str) -> tuple[list[Span], list[Span]]:
        base = base_secrets(text)
        return base, random_strings(text, base, limit, vocabulary)

    return find


def _order(span: Span) -> tuple:
    return span[0], _RANK[span[2]], span[1]


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found.

    ``found`` lists all spans as (kind, start, end), ``spans`` the same as text, in code points.
    Null and empty texts have none. Repeated rows each return a row, a null doc_id stays null,
    other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return arrow_map(rows, summary_batches(_finder(limit, vocabulary), KINDS, BASE, _order), f"doc_id long, {counts}, base_sha256 string, spans string, found {FOUND_SQL}")


def redact(docs: DataFrame, text_col: str = "text", limit: float = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with every secret in the text replaced by [SECRET]; all rows and columns stay, repeats
    too. Null and empty texts stay as they are; an empty table stays one. A task holds one text and
    its copy at a time, whatever its length."""
    return arrow_map(docs, masking_batches(_finder(limit, vocabulary), text_col, lambda _: "[SECRET]"), docs.schema)


def op5_secret_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir)).drop("found")


QUERIES = {"op5_secret_tokens": op5_secret_tokens}
ORACLE_SQL: dict[str, str] = {}
