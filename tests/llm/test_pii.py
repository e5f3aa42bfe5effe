"""Surrogates: formats, coreference and distinctness over a corpus, and a plain second detector."""

import ipaddress
import random
import re

import pytest

from marlstone.llm import pii, queries


@pytest.fixture(scope="module")
def make():
    return pii.Surrogates(b"key")


def test_circles_hold_every_value_once(make):
    for n in (2, 3, 30, 257):
        image = [make.perm.of(i, n, b"t") for i in range(n)]
        assert sorted(image) == list(range(n)) and all(i != x for i, x in enumerate(image))


def test_formats():
    make = pii.Surrogates(b"key")
    text = "Mary Johnson (mary.j@mail.example.com, 4111 1111 1111 1111, 10.1.2.3) met Mary Johnson; DE89 3704 0044 0532 0130 00."
    out, made = pii.replace(text, make)
    assert [k for k, _, _ in made] == ["person", "email", "card", "ip", "person", "iban"]
    assert made[0][2] == made[4][2] and made[0][2].split()[0] in pii.FEMALE and made[0][2].split()[1] in pii.FAMILY
    assert pii.luhn(made[2][2].replace(" ", "")) and made[2][2][0] == "4" and len(out) >= 100
    iban = made[5][2].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pii.replace(text, make)[0] == out != pii.replace(text, pii.Surrogates(b"other"))[0]


def test_writing_is_kept_and_entities_are_one(make):
    a, b = make.find("email", "John.Doe@X.com"), make.find("email", "john.doe@x.com")
    assert a != b and a.lower() == b and a[0].isupper() and a[5].isupper() and a[9].isupper()
    assert make.find("person", "Nina KOWALSKI").lower() == make.find("person", "nina kowalski")
    assert make.find("person", "Nina Kowalski")[:4].endswith("a") and make.find("person", "Herr") != "Herr"
    assert re.sub(r"\D", "", make.find("card", "4111 1111 1111 1111")) == make.find("card", "4111111111111111")
    assert re.sub(r"\D", "", make.find("phone", "+49 30 123456")) == make.find("phone", "+4930123456")[1:]
    whole, short = make.find("ip", "2001:db8:0:0:0:0:0:1"), make.find("ip", "2001:db8::1")
    assert ipaddress.ip_address(whole) == ipaddress.ip_address(short) and whole.count(":") == 7 and "::" in short
    assert make.find("ip", "2001:0DB8::00aB").startswith("2001:0") and make.find("ip", "fe80::1").startswith("fe80::")
    for private in ("10.0.0.1", "192.168.3.4", "172.16.9.9", "127.0.0.1"):
        assert ipaddress.ip_address(make.find("ip", private)).is_private
    assert make.find("secret", "ghp_" + "a1B2" * 6).startswith("ghp_") and make.find("secret", "AKIA" + "Q7" * 8).startswith("AKIA")
    assert make.find("phone", "0171 1234567")[0] == "0"


@pytest.mark.parametrize("kind, draw", [
    ("ip", lambda r: f"{r.choice([1, 10, 192, 172])}.{r.choice([168, 16, 2])}.{r.randint(0, 3)}.{r.randint(0, 40)}"),
    ("ssn", lambda r: f"{r.randint(100, 120)}-{r.randint(10, 20)}-{r.randint(1000, 1020)}"),
    ("phone", lambda r: r.choice(["+49 30 ", "0171 ", "555-0", "+4930"]) + str(r.randint(1000, 1900))),
    ("card", lambda r: str(r.randint(4 * 10**15, 4 * 10**15 + 3000))),
    ("secret", lambda r: "".join(r.choice("ab12xZ") for _ in range(4))),
    ("person", lambda r: r.choice([*pii.FEMALE, *pii.MALE, "Nina", "Al", "Bo", "Ana"]) + " " + r.choice([*pii.FAMILY, "Kowal", "Li", "Lo"])),
    ("email", lambda r: "".join(r.choice("ab.1") for _ in range(3)) + "@" + r.choice(["x.com", "y.com", "x.org"])),
    ("ip", lambda r: f"{r.choice(['fe80', '2001:db8'])}::{r.randint(0, 3):x}:{r.randint(1, 300):x}"),
])
def test_different_entities_have_different_surrogates_in_the_whole_corpus(make, kind, draw):
    rng = random.Random(1)
    values = sorted({draw(rng) for _ in range(3000)})
    forms = {pii._form(kind, v): pii._form(kind, make.find(kind, v)) for v in values}
    assert len(set(forms.values())) == len(forms) and all(a != b for a, b in forms.items())
    other = pii.Surrogates(b"key")
    assert [other.find(kind, v) for v in reversed(values)] == [make.find(kind, v) for v in reversed(values)]


def test_two_documents_agree(spark):
    docs = spark.createDataFrame([(1, "host 1.2.3.4 and 5.160.132.120"), (2, "host 1.2.3.4"), (3, "5.160.132.120, John.Doe@x.com"), (4, "john.doe@x.com")], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["entities"] for r in pii.replace_pii(docs, "k").collect()}
    assert got[1][0]["surrogate"] == got[2][0]["surrogate"] and got[1][1]["surrogate"] == got[3][0]["surrogate"]
    assert got[3][1]["digest"] == got[4][0]["digest"] and got[3][1]["surrogate"].lower() == got[4][0]["surrogate"]


def test_a_plain_detector_finds_nothing_that_was_left(spark, sf_dir, duck):
    """Emails, cards, addresses, account numbers and tokens by walking over words, without the operator's patterns."""
    strip = lambda w: w.strip("()[]<>,;:.!?\"'")

    def plain(text):
        found = set()
        for w in map(strip, (text or "").replace("=", " ").split()):
            at = w.find("@")
            if 0 < at and "." in w[at + 2 : -2] and w.count("@") == 1 and w.isascii():
                found.add(w)
            if w.count(".") == 3 and all(p.isdigit() and int(p) < 256 for p in w.split(".")):
                found.add(w)
            if len(w) == 11 and [len(p) for p in w.split("-")] == [3, 2, 4] and w.replace("-", "").isdigit():
                found.add(w)
            if w.isdigit() and 13 <= len(w) <= 19:
                found.add(w)
        return found

    docs = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_pii"](spark, sf_dir).collect()}
    seen = 0
    for doc, text in docs:
        there = plain(text)
        seen += len(there)
        assert not there & plain(got[doc]["text"])
        if got[doc]["n_entities"] == 0:
            assert got[doc]["text"] == text and not there
    assert seen > 0 and len(got) == len(docs)


def test_very_long_texts_and_long_names(make):
    text = "mail a.b@c.org; " * 50_000 + "Herr " + "X" + "y" * 300
    out, made = pii.replace(text, make)
    assert len(made) == 50_001 and len({s for _, _, s in made}) == 2 and "a.b@c.org" not in out
