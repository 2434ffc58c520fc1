import hashlib
import math
import random
import time
import re

import pytest

from signalloom.llm import pii_semicrf as pii, secret_tokens as sec
from signalloom.llm.spans import Covered, masked


def plain_pii(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        total = sum(x - 9 * (x > 9) for i, d in enumerate(reversed(digits)) for x in [int(d) * (1 + i % 2)])
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def plain_secrets(text):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text) if len(m.group(2)) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    return out + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]


@pytest.mark.parametrize("find, plain, alphabet", [(pii.base_spans, plain_pii, [*"0123456789", ".", "-", " ", "+", "@", "(", ")", "a", "b.", "日", "é"]), (sec.base_secrets, plain_secrets, ["token", "API_KEY", "apikey", "Secret", "ſecret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1", "abcdef01", "0123456789abcdef", "x", "é", "-"])])
def test_base_patterns(find, plain, alphabet):
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 36)))
        assert find(text) == plain(text), text


def test_long_runs_stay_linear():
    for text in ("1" * 100_000, "a" * 200_000 + "@", "a@" * 50_000, "f" * 200_000, "token" * 20_000, "+1 " * 30_000):
        pii.base_spans(text), sec.base_secrets(text)


def test_field_against_all_choices():
    rng = random.Random(6)
    for trial in range(300):
        segments = sorted({(a, a + rng.randint(1, 4), rng.choice("xy")) for a in (rng.randint(0, 9) for _ in range(rng.randint(1, 7)))})
        scores = [rng.uniform(-2, 3) for _ in segments]
        links = {} if trial % 3 == 0 else {(p, q): rng.uniform(-2, 2) for p in ("", "x", "y") for q in "xy"}
        sets = [[]]
        for i, (a, b, _) in enumerate(segments):
            sets += [s + [i] for s in sets if all(b <= segments[j][0] or segments[j][1] <= a for j in s)]

        def row(chosen):
            kinds = ["", *(segments[i][2] for i in sorted(chosen, key=lambda i: segments[i][0]))]
            return list(zip(kinds, kinds[1:]))

        value = lambda s: sum(scores[i] for i in s) + sum(links.get(x, 0.0) for x in row(s))
        assert value(pii.viterbi(segments, scores, links)) == pytest.approx(max(map(value, sets)))
        z = sum(math.exp(value(s)) for s in sets)
        chances, expected = pii.marginals(segments, scores, links)
        assert chances == pytest.approx([sum(math.exp(value(s)) for s in sets if i in s) / z for i in range(len(segments))])
        for pair in {x for s in sets for x in row(s)}:
            assert expected[pair] == pytest.approx(sum(math.exp(value(s)) * row(s).count(pair) for s in sets) / z)


#: Written by hand, apart from the generator: (sentence, the spans to find with their kinds).
SENTENCES = [
    ("Please ring Ms. O'Neil tomorrow.", [("Ms. O'Neil", "name")]),
    ("Her passport no 533380006 expired.", [("533380006", "id")]),
    ("My phone 07700 900123 is always on.", [("07700 900123", "phone")]),
    ("Write to jane dot doe at example dot com for details.", [("jane dot doe at example dot com", "email")]),
    ("Dr. Maria van Houten will see you at 14 Baker Street.", [("Dr. Maria van Houten", "name"), ("14 Baker Street", "address")]),
    ("Call 212-555-0187 or 212-555-0199 before noon.", [("212-555-0187", "phone"), ("212-555-0199", "phone")]),
    ("His SSN is 219-09-9999 and he was born on 12/03/1975.", [("219-09-9999", "id"), ("12/03/1975", "birth")]),
    ("Transfer to IBAN DE89 3704 0044 0532 0130 00 today.", [("DE89 3704 0044 0532 0130 00", "iban")]),
    ("Prof. Smith-Jones lectures on Monday.", [("Prof. Smith-Jones", "name")]),
    ("The office is at 221 Kings Road, near the river.", [("221 Kings Road", "address")]),
    ("contact: bob (at) mail.org", [("bob (at) mail.org", "email")]),
    ("Fax: (415) 555-2671 works too.", [("(415) 555-2671", "phone")]),
    ("Date of birth: 1988-07-21, Leeds.", [("1988-07-21", "birth")]),
    ("Mr McDonald and Mrs. Lee came late.", [("Mr McDonald", "name"), ("Mrs. Lee", "name")]),
    ("Text me on 020 7946 0958 please.", [("020 7946 0958", "phone")]),
    ("National insurance no 48213377 was missing.", [("48213377", "id")]),
    ("Tel. 0171/5551234 is the front desk.", [("0171/5551234", "phone")]),
    ("Mobile: 0612 345678.", [("0612 345678", "phone")]),
    ("Miss A. Carter signed it.", [("Miss A. Carter", "name")]),
    ("He lives at 9 Old Mill Lane in Bath.", [("9 Old Mill Lane", "address")]),
    *((x, []) for x in (
        "Invoice 20391847 was paid on 2019-04-02.", "See pages 112-118 and chapter 4.", "ISBN 978-0-306-40615-7 is sold out.", "The match ended 3-2 after 120 minutes.", "Order 555-12-9981 shipped from warehouse 7.",
        "Between 1914-1918 millions died.", "Version 10.04.2 was built on 2021-11-30.", "The serial number is 4400 1234 5678.", "Meet at dawn dot and dash were the signals.", "It costs 1.250.000 euros in total.",
    )),
]


def test_hand_written_sentences():
    find = pii._finder(pii.trained(), pii.MARGIN)
    right = wrong = missed = 0
    for text, want in SENTENCES:
        base, added = find(text)
        got = {(text[a:b], k) for a, b, k in base + added}
        right, wrong, missed = right + len(got & set(want)), wrong + len(got - set(want)), missed + len(set(want) - got)
    assert right / (right + wrong) >= 0.9 and right / (right + missed) >= 0.9


#: Written by hand after the last candidates, before they were run on these.
LATER = [
    ("Hello, my name is John Smith and I lost my card.", [("John Smith", "name")]),
    ("DOB 3 March 1984, no allergies.", [("3 March 1984", "birth")]),
    ("NHS number 943 476 5919 is on file.", [("943 476 5919", "id")]),
    ("Tel. 0049 89 123456 rings at the desk.", [("0049 89 123456", "phone")]),
    ("Best Regards, Alice Brown", [("Alice Brown", "name")]),
    ("She was born on August 12, 1990 in Rome.", [("August 12, 1990", "birth")]),
    ("I am Peter O'Toole, the new tenant.", [("Peter O'Toole", "name")]),
    ("Telephone 0033 1 44556677 for help.", [("0033 1 44556677", "phone")]),
    ("Patient number 4857773456 was moved.", [("4857773456", "id")]),
    *((x, []) for x in ("The fair opened on 12 May 2019 again.", "Totals: 120 340 560 780 990 120 340 560", "2001 2002 2003 2004 2005 2006", "Signed: yes.", "I am Not sure.", "It was dated June 3, 1999 by the clerk.")),
]


def test_later_sentences():
    find = pii._finder(pii.trained(), pii.MARGIN)
    right = wrong = missed = 0
    for text, want in LATER:
        base, added = find(text)
        got = {(text[a:b], k) for a, b, k in base + added}
        right, wrong, missed = right + len(got & set(want)), wrong + len(got - set(want)), missed + len(set(want) - got)
    print("personal data in later sentences: right", right, "wrong", wrong, "missed", missed)
    assert right / (right + missed) >= 0.75 and right / (right + wrong) >= 0.75


@pytest.mark.parametrize("text", ["12 " * 26_000, "1234 5678 90 " * 6000, "3.14 2.71 1.41 " * 5000, "2021-03-04 17 2021-03-05 19 " * 3000])
def test_tables_of_numbers(text):
    """A plain table of numbers is nobody's data, and takes a bounded time a character."""
    find = pii._finder(pii.trained(), pii.MARGIN)
    start = time.time()
    assert len(find(text)[1]) <= 2
    assert time.time() - start < 20


def test_field_finds_and_leaves():
    find = pii._finder(pii.trained(), pii.MARGIN)
    added = lambda t: [(t[a:b], k) for a, b, k in find(t)[1]]
    assert ("555-123-4567", "phone") in added("please call 555-123-4567 today")
    assert ("123-45-6789", "id") in added("her SSN 123-45-6789 was printed")
    assert added("order 123456789012 of isbn 978-3-1614-8410-0 on pages 123-456") == []
    tp = fp = fn = 0
    for text, spans in pii.examples(300, seed=99):
        got = set(find(text)[0]) | set(find(text)[1])
        tp, fp, fn = tp + len(got & set(spans)), fp + len(got - set(spans)), fn + len(set(spans) - got)
    assert tp / (tp + fp) > 0.8 and tp / (tp + fn) > 0.8


def test_random_strings():
    find = sec._finder(sec.LIMIT, sec.VOCABULARY)
    rng = random.Random(7)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hits = sum(bool(find("key " + "".join(rng.choices(alphabet, k=32)) + " end")[1]) for _ in range(300))
    assert hits >= 290
    for text in ("d41d8cd98f00b204e9800998ecf8427e", "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "123e4567-e89b-12d3-a456-426614174000", "handle_http_request_with_retry_policy", "2024-01-01-annual-report-final-3", "a" * 30 + "1"):
        assert find(f"see {text} here")[1] == [], text


SHAPES = {"letters": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "mixed": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}
SHAPES |= {"base64": SHAPES["mixed"] + "+/", "signs": SHAPES["mixed"] + "!#$%&*@^~"}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("length", [20, 24, 40])
def test_recall_by_shape(shape, length):
    rng = random.Random(length)
    hits = 0
    for _ in range(100):
        text = f"the key {''.join(rng.choices(SHAPES[shape], k=length))} was sent"
        base = sec.base_secrets(text)
        hits += sum(b - a for a, b, _ in base + sec.random_strings(text, base)) >= 0.8 * length
    assert hits >= 90


def test_no_alarm_in_plain_texts(spark):
    """The tables hold only secrets of the base kinds: every other run of theirs is a word, a name or an address."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert sum(len(sec.random_strings(t, sec.base_secrets(t))) for t in texts) == 0


def test_masking():
    assert masked("abcdef", [(1, 3, "x"), (2, 4, "y")], str.upper) == "aXef"
    assert masked("abc", [], str.upper) == "abc"
    c = Covered([(5, 7, ""), (1, 3, ""), (2, 4, "")])
    assert [c.overlaps((a, a + 1, "")) for a in range(8)] == [False, True, True, True, False, True, True, False]


@pytest.mark.parametrize("module, run, change", [(pii, pii.personal_data, pii.mask), (sec, sec.secrets, sec.redact)])
def test_rows(spark, odd_docs, no_docs, module, run, change):
    got = run(odd_docs).collect()
    assert len(got) == 9 and {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()} and {r.spans for r in got} == {""}
    assert run(no_docs).count() == 0
    same = change(odd_docs)
    assert same.columns == odd_docs.columns
    assert sorted(map(str, same.collect())) == sorted(map(str, odd_docs.collect()))


def test_digests(spark):
    text = "é a.b@c.de 1.2.3.4 +1 (234) 555-7890"
    r = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 1)
    assert r.base_sha256 == hashlib.sha256(b"email:2:10,ip:11:18,phone:19:36").hexdigest()
    text = "é AKIAABCDEFGHIJKL token = 'abcdefgh1' " + "0" * 32
    r = sec.secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.spans == "access:2:18,assign:19:37,hex:39:71" and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert sec.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == "é [SECRET] [SECRET]' [SECRET]"


@pytest.mark.parametrize("run", ["kJhQzXwVbNtRpLmGfDcYsKqZ", "qzxjvkwptbhgmfdcqzrwxkjv", "QZXJVKWPTBHGMFDCQZRWXKJV", "kJhQzX_wVbNtR_pLmGfD-42-cYsKqZ"])
def test_random_letters_are_found(spark, run):
    text = f"the key {run} was sent"
    assert sec.random_strings(text, []) == [(8, 8 + len(run), "random")]
    assert sec.redact(spark.createDataFrame([(text,)], "text string")).first().text == "the key [SECRET] was sent"


@pytest.mark.parametrize("run", ["getUserNameByIdentifier", "some_long_snake_case_name", "MAX_CONNECTION_POOL_SIZE_LIMIT", "internationalization-and-localization", "test_2024_01_02_run_12_of_300", "Donaudampfschifffahrtsgesellschaft", "2024-01-02-12-30-55-1234"])
def test_identifiers_stay(run):
    assert sec.random_strings(f"the name {run} was sent", []) == []


@pytest.mark.parametrize("phones", [[f"020 7946 01{k:02}" for k in range(1, 30)], [f"212.555.01{k:02}" for k in range(1, 30)]])
def test_no_number_of_a_long_row_is_cut(phones):
    text = "call " + " ".join(phones) + " today"
    proposed = {(a, b) for group in pii.islands(text) for a, b, kind in group if kind == "phone"}
    assert {(text.index(p), text.index(p) + len(p)) for p in phones} <= proposed


def test_number_runs_against_a_pattern():
    plain = re.compile(r"(?<![\w.+/-])[(]?[0-9][0-9() ./-]{5,}[0-9](?![\w/-])")
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choices("0123456789() ./-+aé", [3] * 10 + [1, 1, 5, 1, 1, 1, 0.3, 0.3, 0.3], k=rng.randint(0, 60)))
        assert pii.number_runs(text) == [m.span() for m in plain.finditer(text)], text
