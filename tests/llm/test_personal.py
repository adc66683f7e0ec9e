"""Personal information: what is found and what isn't, placeholders, and the pseudonyms' round trip."""

import random
import string
import time

import pytest
from pyspark.sql import functions as F

from recallix.llm.personal import Finder, contents, find_personal, given_names, permute, pseudonym, pseudonym_date, pseudonym_of_date, redact_personal

NAMES = ["Augusta", "Timothy", "Gilbert", "Patricia", "Art"]
FOUND = [
    ("Write to a.b+c@mail.example.org instead.", "email"), ("cc joe [at] example [dot] com please", "email"), ("joe (at) letters.test", "email"), ("joe at mail dot example dot org", "email"),
    ("Call +49 30 23125 079 now", "phone"), ("Call (305) 555-0126", "phone"), ("617.555.0185", "phone"), ("001-305-5550133x96 is it", "phone"), ("07700 900515", "phone"), ("01 99 00 58 79", "phone"), ("(02) 5550 9090", "phone"),
    ("SSN 666-44-7065", "id_number"), ("000 35 4114", "id_number"), ("Passport DN1454609 expires", "id_number"), ("21202352-J", "id_number"), ("TT 80 91 75 N", "id_number"), ("T 29 595 072", "id_number"), ("99/133/17217", "id_number"), ("474948-2682", "id_number"),
    ("at 79 Hospika Street now", "address"), ("239 kakfor lane", "address"), ("Zantusstraße 180", "address"), ("Via Nolror, 159", "address"), ("60, rue Delvor", "address"), ("20/99 Nelsikus Rd. is home", "address"), ("Calle Gamvujika 104", "address"), ("Barpijenweg 75b", "address"),
    ("We met Augusta Norlika there", "name"), ("augusta norlika signed", "name"), ("AUGUSTA NORLIKA", "name"), ("from Norlika, Augusta.", "name"), ("Dr. Norlika called", "name"), ("Ask K. Dulsamen about it", "name"), ("Ms Samvaben", "name"), ("Timothy R. Lonpus", "name"),
]
NOT_FOUND = ["Order 2023587-51 ships late.", "Invoice 4471-2290-18 is open.", "Lot 896-58-A passed.", "Part no. 149/17 fits.", "Hash 7f411c48e0 matches.", "Budget is 468,150 credits.", "Running build 10.4.3.2201 now.", "See chapter 72, page 299.", "Main Street traffic grew by 54 percent.", "The Long Lane exhibition closes soon.", "Ask the Hastegus office about it.", "Norlika Foods signed the form.", "Augusta signed the form.", "Use the @channel tag sparingly.", "The art of war.", "Send 528 units @ 43.50 each.", ""]


@pytest.fixture(scope="module")
def finder():
    return Finder(NAMES)


@pytest.mark.parametrize("text, kind", FOUND)
def test_found(finder, text, kind):
    assert {k for _, _, k in finder.find(text)} == {kind}


@pytest.mark.parametrize("text", NOT_FOUND)
def test_not_found(finder, text):
    assert finder.find(text) == []


def test_long_text(finder):
    text = "lorem ipsum 12 " * 20_000 + "mail a@b.org"
    assert [k for _, _, k in finder.find(text)] == ["email"]


@pytest.mark.parametrize("run", ["a", "1", " ", "a.", "A ", "1-", "@", "at ", "(", "passport ", "x@", "\n", "é", "Augusta "])
def test_long_runs_take_no_longer_than_they_are(finder, run):
    began = time.perf_counter()
    finder.find(run * (200_000 // len(run)))
    assert time.perf_counter() - began < 20


def test_permutation_is_one():
    for size in (2, 3, 10, 97, 1000):
        assert sorted(permute(i, size, b"k") for i in range(size)) == list(range(size))
        assert all(permute(permute(i, size, b"k"), size, b"k", back=True) == i for i in range(size))


def test_pseudonyms_keep_their_format_and_come_back():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(string.digits + string.ascii_uppercase + " -/") for _ in range(rng.randrange(1, 16)))
        other = pseudonym(text, b"key", "id_number")
        assert [c.isdigit() for c in other] == [c.isdigit() for c in text] and pseudonym(other, b"key", "id_number", back=True) == text
    assert pseudonym("666-44-7065", b"k", "id_number").replace("-", "") == pseudonym("666 44 7065", b"k", "id_number").replace(" ", "")
    y, m, d = pseudonym_date(1987, 2, 28, b"k")
    assert pseudonym_date(y, m, d, b"k", back=True) == (1987, 2, 28)


def test_phones_keep_their_code_and_stay_linked():
    a, b, c = (pseudonym(t, b"k", "phone") for t in ("+49 30 23125 079", "030 23125079", "0049-30-23125079 x12"))
    digits = lambda t: "".join(x for x in t if x.isdigit())
    assert a.startswith("+49 ") and digits(a)[2:] == digits(b)[1:] == digits(c)[4:-2] and b[0] == "0" and "30 23125" not in a
    for t in ("+49 30 23125 079", "030 23125079", "001-305-5550133x96", "(305) 555-0126", "+358 40 123", "07"):
        assert pseudonym(pseudonym(t, b"k", "phone"), b"k", "phone", back=True) == t


@pytest.mark.parametrize("text", ["1850-01-01", "0001-01-01", "9999-12-31", "1899-12-31", "1900-01-01", "2099-12-31", "2100-01-01", "3 May 1985", "May 13th, 1985", "28.02.1985", "3 Sep 2001"])
def test_dates_come_back(text):
    other = pseudonym_of_date(text, b"k")
    assert other != text and pseudonym_of_date(other, b"k", back=True) == text


def test_birth_dates(finder):
    for text in ("She was born on 3 May 1985.", "DOB 03/05/1985", "Birthday: May 3, 1985"):
        out, kinds = finder.redact(text, b"k")
        assert "1985" not in out and kinds == ["date"]
    assert pseudonym_of_date("3 May 1985", b"k").split()[0] == str(pseudonym_date(1985, 5, 3, b"k")[2])
    assert pseudonym_of_date("31.02.1985", b"k") is None


def test_many_hits_take_no_longer_than_they_are(finder):
    began = time.perf_counter()
    out, kinds = finder.redact("mail a.b@mail.org or 617-555-0185. " * 10_000, b"k")
    assert kinds == ["email", "phone"] and out.count("[EMAIL:") == 10_000 and time.perf_counter() - began < 20


def test_redaction_links_equal_values(finder):
    a = finder.redact("Call 617-555-0185 or mail Joe@Example.org, says Augusta Norlika. Born 1987-02-28.", b"k")[0]
    b = finder.redact("joe [at] example [dot] org, 617.555.0185; NORLIKA, Augusta", b"k")[0]
    assert "Joe" not in a and "555-0185" not in a and "1987" not in a and a.startswith("Call [PHONE:")
    tag = lambda t, kind: t.split(f"[{kind}:")[1].split("]")[0]
    assert tag(a, "PHONE").replace("-", "") == tag(b, "PHONE").replace(".", "") and tag(a, "EMAIL") == tag(b, "EMAIL") and tag(a, "NAME") == tag(b, "NAME")
    assert finder.redact("nothing here", b"k") == ("nothing here", [])


def test_messages():
    assert contents('[{"content": "a\\u00e9"}, {"role": "x"}, "z"]') == ["aé", "", "z"]
    assert contents('[{"content": "call 617-555"}, {"content": "or 30\\u00') == ["call 617-555", "or 30"]
    assert contents(None) == contents("") == contents('{"a": 1}') == []


def test_tables(spark):
    texts = spark.createDataFrame([("k", 1, "text", "a@b.org and c@d.org"), ("k", 1, "text", "a@b.org and c@d.org"), ("k", 2, "text", None), ("e", 3, "messages", '[{"content": ""}, {"content": "Ask Augusta Norlika, 617-555-0185"}]'), ("e", 4, "messages", "junk")], "src string, row_id bigint, field string, text string").withColumn("pos", F.lit(7))
    got = {tuple(r) for r in find_personal(texts, NAMES, b"k").collect()}
    assert got == {("k", 1, "text", 0, "email"), ("e", 3, "messages", 1, "name"), ("e", 3, "messages", 1, "phone")}
    assert find_personal(texts.limit(0), NAMES, b"k").count() == 0
    out = {(r.row_id, r.pos): r.text for r in redact_personal(texts, NAMES, b"k").collect()}
    assert "Norlika" not in out[(3, 1)] and "@" not in out[(1, 0)]
    assert given_names(spark.createDataFrame([("Ann", None), ("Bo", "B")], "given string, short_form string")) == ["Ann", "B", "Bo"]
