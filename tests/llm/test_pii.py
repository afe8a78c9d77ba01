"""Base spans against plain patterns, spans that contexts reveal, and masking."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from ostinato.llm.pii import KINDS, _candidates, base_spans, find_pii, mentions, redact_pii, redacted, sha256_of

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    found = [(0, *m.span()) for m in EMAIL.finditer(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


CASES = [
    "",
    "a@b.c d@e f@g.h.i.j. x@@y.z a.b@c-d.e@f.g @h.i %@1.2",
    "1.2.3.4 1.2.3.4.5 256.1.1.1 0001.2.3.4 1.2.3 1..2.3.4 12.34.56.78.9.10.11.12",
    "4111 1111 1111 1111 4111-1111-1111-1111x 41111111111111112 4111 1111  1111 1111",
    "+1 (555) 010-9999 +49.30.1234567 +1 555 +12345678901234567 ++15550109999 +1-) 2",
    "١٢٣٤@b.c １.2.3.4 +１23456789",
]


def test_cases():
    for text in CASES:
        assert base_spans(text) == plain(text), text


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="01.2 -+()@ab%é\n5", max_size=60))
def test_random(text):
    assert base_spans(text) == plain(text)


def test_long_runs():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "+1" * 50_000, "1." * 50_000, "1 " * 100_000):
        assert base_spans(text) is not None
        assert list(_candidates(text, base_spans(text))) is not None


def fixture():
    """Many numbers after ``member card``, some of which fail the check digit; other numbers elsewhere."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        number = "".join(rng.choices("123456789", k=15))
        check = next(d for d in "0123456789" if luhn(number + d))
        rows.append((i, f"dear {i} your member card {number}{check} expires soon", "x"))
    for i in range(60, 65):
        number = next(n for n in range(1234567890120000 + 100 * i, 1234567890129999) if not luhn(str(n)))
        rows.append((i, f"your member card {number} expires soon", "x"))
    for i in range(70, 90):
        rows.append((i, f"serial number 98765432101{i} was shipped to a@b.c from 10.0.0.{i}", "x"))
    return rows


def test_contexts(spark):
    rows = [*fixture(), (100, None, "y"), (100, None, "y"), (101, "", None), (None, "x@y.z", "x"), (3, "other text +1 555 010 9999", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = find_pii(docs).collect()
    assert len(found) == len(rows)
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(str(i), []).append(t or "")
    for r in found:
        options = [t for t in texts[str(r.doc_id)] if sha256_of(plain(t)) == r.base_sha256]
        assert options
        base = plain(options[0])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in range(4))
        spans = [s for s in r.spans.split(",") if s]
        assert {f"{KINDS[k]}:{a}:{b}" for k, a, b in base} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
    more = {r.doc_id: r.spans for r in found if r.n_more}
    assert set(more) == set(range(60, 65)) and all(s.startswith("card:17:33") for s in more.values())
    assert find_pii(docs.limit(0)).count() == 0


def test_masking(spark):
    rows = [(1, "ip 1.2.3.4, mail a@b.c!", 3), (1, "ip 1.2.3.4, mail a@b.c!", 3), (2, None, None), (None, "+1 555 010 9999", 9), (3, "é", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = redact_pii(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(
        f"Row(doc_id={i}, text={t!r}, n_chars={n})"
        for i, t, n in [(1, "ip [IP], mail [EMAIL]!", 22)] * 2 + [(2, None, None), (None, "[PHONE]", 7), (3, "é", 1)]
    )
    assert redacted("0123456789", "email:2:6,ip:2:4,card:5:7,phone:8:9") == "01[EMAIL]67[PHONE]9"


def test_address_without_digits(spark):
    """Texts with neither a digit nor an at sign still have loose mentions."""
    rows = [(i, f"please write to {'abcdefgh'[i]}x@example.com for details") for i in range(8)]
    rows += [(20, "please write to jane(at)example.com for details"), (21, "please write to joe[at]example.com for details"), (22, "no one (at) home")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    more = {r.doc_id: r.spans for r in find_pii(docs).collect() if r.n_more}
    assert more == {20: "email:16:35", 21: "email:16:34"}
    assert redact_pii(docs).filter("doc_id = 20").first().text == "please write to [EMAIL] for details"
    seen = mentions(spark.createDataFrame([(1, "host de:ad:be:ef is up")], "doc_id long, text string")).first().mentions
    assert [(m.kinds, m.value) for m in seen] == [([1], "de:ad:be:ef")]
