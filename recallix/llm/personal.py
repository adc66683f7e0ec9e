"""Personal information in free text: where it is, and the text with typed placeholders and pseudonyms."""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- format-preserving pseudonyms --------------------------------------------------------------------------


def _round(key: bytes, tweak: bytes, i: int, value: int, modulus: int) -> int:
    return int.from_bytes(hmac.new(key, b"%d|%d|%d|" % (i, value, modulus) + tweak, hashlib.sha256).digest()[:16], "big") % modulus


def permute(value: int, size: int, key: bytes, tweak: bytes = b"", back: bool = False, rounds: int = 10) -> int:
    """A keyed permutation of 0..size-1 (its inverse with back): a Feistel network over two unequal halves.

    Values are written in two digits of about sqrt(size); results beyond size are permuted again (cycle walking).
    """
    if size < 2:
        return value
    high = max(2, int(size**0.5))
    low = -(-size // high)
    while True:
        a, b = divmod(value, low)
        for i in reversed(range(rounds)) if back else range(rounds):
            sign = -1 if back else 1
            if i % 2 == 0:
                a = (a + sign * _round(key, tweak, i, b, high)) % high
            else:
                b = (b + sign * _round(key, tweak, i, a, low)) % low
        value = a * low + b
        if value < size:
            return value


def _permute_digits(digits: str, key: bytes, tweak: bytes, back: bool) -> str:
    """Digits of the same number; a first digit other than 0 stays other than 0."""
    n, low = len(digits), 10 ** (len(digits) - 1) if digits[:1] not in ("", "0") else 0
    size = 10**n - low if low else 10 ** (n - 1)
    return str(low + permute(int(digits) - low, size, key, tweak + (b"" if low else b"/0"), back)).zfill(n) if n > 1 else str(permute(int(digits), 10, key, tweak, back)) if n else ""


#: Country codes of one and of two digits; all others have three.
COUNTRY_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def _phone_parts(text: str, digits: str) -> tuple[int, int]:
    """How many digits come before the national number (country code or trunk zero), and how many belong to it."""
    own = sum(c in "0123456789" for c in re.split(r"(?i)x|ext", text)[0])
    code = 2 if digits.startswith("00") else 0
    if code or text.lstrip().startswith("+"):
        rest = digits[code:]
        return code + next((n for n in (1, 2) if rest[:n] in COUNTRY_CODES), 3), own
    return int(digits.startswith("0")), own


def pseudonym(text: str, key: bytes, kind: str, back: bool = False) -> str:
    """The text with its digits and its letters permuted within their format; all else stays.

    All digits are one number, all letters (but the mark of a phone's extension) one more, whatever their case, so
    equal values, in equal or other spacing, get equal digits wherever they occur. A phone keeps its country code or
    trunk zero, so `+49 30 1234567` and `030 1234567` stay linked; its extension is permuted by itself. back undoes it.
    """
    at = [i for i, c in enumerate(text) if c in "0123456789"]
    letters = [i for i, c in enumerate(text) if c.isascii() and c.isalpha()] if kind != "phone" else []
    out = list(text)
    digits = "".join(text[i] for i in at)
    if kind == "phone":
        a, z = _phone_parts(text, digits)
        new = digits[:a] + _permute_digits(digits[a:z], key, b"phone", back) + _permute_digits(digits[z:], key, b"phone/extension", back)
    else:
        new = f"{permute(int(digits), 10 ** len(digits), key, kind.encode(), back):0{len(digits)}d}" if digits else ""
    for i, c in zip(at, new):
        out[i] = c
    if letters:
        value = 0
        for i in letters:
            value = value * 26 + ord(text[i].lower()) - 97
        value = permute(value, 26 ** len(letters), key, kind.encode() + b"/letters", back)
        for i in reversed(letters):
            value, c = divmod(value, 26)
            out[i] = chr(97 + c).upper() if text[i].isupper() else chr(97 + c)
    return "".join(out)


def pseudonym_date(year: int, month: int, day: int, key: bytes, back: bool = False) -> tuple[int, int, int]:
    """Another valid date, permuted by its day number: dates of 1900 to 2099 among themselves, all others of 1 to 9999."""
    first, end = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()
    n, size = datetime.date(year, month, day).toordinal(), datetime.date.max.toordinal() - (end - first)
    if first <= n < end:
        n = first + permute(n - first, end - first, key, b"date", back)
    else:
        n = permute(n - 1 if n < first else n - 1 - (end - first), size, key, b"date/far", back) + 1
        n = n if n < first else n + end - first
    at = datetime.date.fromordinal(n)
    return at.year, at.month, at.day


MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") for m in MONTHS)
#: Notations of a date: its pattern, and the groups of year, month and day.
DATES = [(r"(\d{4})-(\d{1,2})-(\d{1,2})", (1, 2, 3)), (r"(\d{1,2})([./-])(\d{1,2})\2(\d{4})", (4, 3, 1)), (rf"(\d{{1,2}})(?:st|nd|rd|th)? (?:of )?({_MONTH})\.?,? (\d{{4}})", (3, 2, 1)), (rf"({_MONTH})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})", (3, 1, 2))]


def pseudonym_of_date(text: str, key: bytes, back: bool = False) -> str | None:
    """The text of a date in any notation with another date in the same one; None if there is no such date.

    All-numeric dates are day first where that makes a date, else month first.
    """
    for pattern, groups in DATES:
        if m := re.fullmatch(pattern, text, re.I):
            orders = [groups, (groups[0], groups[2], groups[1])] if len(m.groups()) == 4 else [groups]
            for y, mo, d in orders:
                month = int(m[mo]) if m[mo].isdigit() else next(i for i, n in enumerate(MONTHS, 1) if n[:3].lower() == m[mo][:3].lower())
                try:
                    new = pseudonym_date(int(m[y]), month, int(m[d]), key, back)
                except ValueError:
                    continue
                wide = 2 if m[mo].isdigit() else 1
                shown = {y: f"{new[0]:04d}", mo: f"{new[1]:0{wide}d}" if m[mo].isdigit() else MONTHS[new[1] - 1][: 3 if len(m[mo]) == 3 and month != 5 else None], d: f"{new[2]:0{wide}d}"}
                out = text
                for g in sorted((y, mo, d), key=m.start, reverse=True):
                    out = out[: m.start(g)] + shown[g] + out[m.end(g) :]
                return out
    return None


# --- where it is -------------------------------------------------------------------------------------------

_A, _Z = r"(?<![\w@/.+-])", r"(?![\w/@]|[.-]\d)"
#: Starts at the start of a run only and takes at most 64 letters of it, so a long run costs no more than its length.
_LOCAL = r"(?<![\w.+%-])[\w.+%-]{1,64}"
EMAIL = re.compile(
    rf"{_LOCAL}@[\w-]{{1,63}}(?:\.[\w-]{{1,63}})*\.[a-z]{{2,}}"
    rf"|{_LOCAL}\s{{0,3}}[\[({{<]\s{{0,3}}(?:at|@)\s{{0,3}}[\])}}>]\s{{0,3}}[\w-]{{1,63}}(?:(?:\s{{0,3}}[\[({{<]\s{{0,3}}(?:dot|\.)\s{{0,3}}[\])}}>]\s{{0,3}}|\.)[\w-]{{1,63}})*(?:\s{{0,3}}[\[({{<]\s{{0,3}}(?:dot|\.)\s{{0,3}}[\])}}>]\s{{0,3}}|\.)[a-z]{{2,}}"
    rf"|{_LOCAL}\s{{1,3}}at\s{{1,3}}[\w-]{{1,63}}(?:\s{{1,3}}dot\s{{1,3}}[\w-]{{1,63}})*\s{{1,3}}dot\s{{1,3}}[a-z]{{2,}}"
    rf"|{_LOCAL}\s{{1,3}}@\s{{1,3}}[\w-]{{1,63}}(?:\s{{0,3}}\.\s{{0,3}}[\w-]{{1,63}})*\s{{0,3}}\.\s{{0,3}}[a-z]{{2,}}",
    re.I,
)
ID_NUMBER = re.compile(
    rf"{_A}(?:\d{{3}}([- ])\d{{2}}\1\d{{4}}|\d{{6}}-\d{{4}}|\d{{8}}-?[A-Z]|[A-Z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-Z]|[A-Z]{{1,2}}\d{{7,8}}|[A-Z] \d{{2}} \d{{3}} \d{{3}}|\d{{2}}/\d{{3}}/\d{{5}}){_Z}",
    re.I,
)
#: Words after which a number is a person's.
ID_CUE = re.compile(r"(?:passport|ssn|social security|national id|identity (?:card|number)|tax (?:number|id)|taxpayer|driving licen[cs]e|driver'?s licen[cs]e|insurance (?:no|number)|insured under)\b(?:\s{0,3}(?:no|number|nr|id|is|so)\b\.?|[:#,.]){0,4}\s{0,3}([A-Z]{0,3}[ -]?\d[\dA-Z]*(?:[ /-][\dA-Z]*\d[\dA-Z]*){0,5}(?:[ -][A-Z])?)(?!\w)", re.I)
PHONE = re.compile(
    rf"{_A}(?:\+\d{{1,3}}(?:[ .-]?\(\d{{1,4}}\))?(?:[ .-]?\d{{2,6}}){{2,5}}|00\d?[ .-]\d{{2,4}}(?:[ .-]?\d{{2,7}}){{1,4}}|\(\d{{2,5}}\)[ .-]?\d{{3,4}}(?:[ .-]?\d{{3,4}}){{0,2}}|\d{{3}}([.-])\d{{3}}\1\d{{4}}|0\d{{3,4}} \d{{3}} ?\d{{3,4}}|0\d(?:[ .]\d\d){{4}})(?:\s?(?:x|ext\.?)\s?\d{{1,6}})?(?![\w/@]|-\d|\.\d)",
    re.I,
)
#: How streets are called.
_STREETS = r"street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|boulevard|blvd\.?|drive|court|way|place|square|terrace|crescent|close|row"
_NAME = r"[^\W\d_][\w'’-]{2,}"
ADDRESS = re.compile(
    rf"(?<![\w.-])\d{{1,5}}(?:/\d{{1,4}})?[a-z]?,? (?:{_NAME} ){{1,3}}(?:{_STREETS})(?!\w)(?:,? (?:apt|apartment|suite|unit|floor|no)\.? ?\d{{1,4}})?"
    rf"|(?<![\w.-])\d{{1,5}}[a-z]?,? (?:rue|avenue|boulevard|place|chemin|impasse|quai|allée) (?:(?:de|du|des|la|le|les) |d['’]|l['’])*{_NAME}"
    rf"|(?<!\w)(?:calle|via|viale|piazza|corso|rua|avenida|plaza|paseo|rue|travessa|largo|strada|ulitsa|улица|ул\.) (?:(?:de|del|della|dei|la|las|los|do|da|dos) )*{_NAME}(?: {_NAME})?,? (?:n\.?º? ?)?\d{{1,5}}[a-z]?(?!\w)"
    r"|(?<!\w)[^\W\d_][\w-]+(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|straat|laan|gracht|plein|kade) \d{1,5} ?[a-z]?(?!\w)",
    re.I,
)
_BIRTH = re.compile(r"(?<!\w)(?:born(?: on)?|birth(?:day| ?date)?|dob|date of birth)\W{1,3}(?:is |was |on )?(" + "|".join(re.sub(r"\((?!\?)", "(?:", p).replace(r"\2", "[./-]") for p, _ in DATES) + r")(?!\w)", re.I)
_TITLED = re.compile(rf"(?<!\w)(?:dr|prof|professor|doctor|mr|mrs|ms|miss|frau|herr|mme|madame|monsieur|sra?|signora?|señora?|dame|sir|lady|lord)\b\.?(?: (?:dr|prof)\b\.?)?\s+((?:[a-z]\. ?)*{_NAME}(?: {_NAME})?)", re.I)
_INITIAL = re.compile(r"(?<![\w.])(?:[A-Z]\. ?){1,3}([A-Z][\w'’-]{4,})(?!\w)")
_SMALL_INITIAL = re.compile(r"(?:\b(?:ask|met|from|by|per|with|doctor is|regards,?)|[|;\-*(])\s+((?:[a-z]\. ?){1,2}([^\W\d_][\w'’-]{4,}))(?!\w)", re.I)
_CUED = re.compile(r"(?:\b[Aa]sk|\b[Mm]et|\b[Rr]egards,|\b[Ss]incerely,|\b[Dd]ear|\b[Cc]ontact|doctor is|came from|\b[Aa]s per)\s+([A-Z][\w’']{2,} (?:[A-Z]\. )?([A-Z][\w’'-]{3,}))(?!\w)")
_SIGNED = re.compile(r"(?<![\w.])([A-Z][\w’']{2,} (?:[A-Z]\. )?([A-Z][\w’'-]{3,}))(?= (?:has |have )?(?:signed|wrote|called|replied|phoned)\b)")
_AFTER = re.compile(r"(?:-|\s+(?:[^\W\d_]\.\s*){0,2}|\s*\n\s*)([^\W\d_][\w'’-]+)")
_BEFORE = re.compile(r"([^\W\d_][\w'’-]{3,}),\s*$")
_NEXT = re.compile(r"\s+([^\W\d_][\w'’-]*)")
#: Words that go with firms, streets and offices, so that the name before them isn't a person's.
ORGANISED = set("foods logistics office offices crew team group company inc ltd gmbh corp industries holdings bank hospital university institute museum station airport street road avenue lane square park garden hall library school bridge center centre foundation association services systems partners brothers".split())
#: Common words, which aren't surnames.
COMMON = set(
    "a about above after again against all also am an and any are as asked at be because been before being below between both but by call called came can cannot could deliver did do does doing don done down draft during each every few for form from further get go goes got had has have having he her here hers herself him himself his home how i if in indeed into is it its itself just last like likes made make may me meets met mine more most must my near never new no nobody nor not now of off office on once one only open or other our out over own paid per please rang reach reported rest ring room route said same says sells send sent she should signed since so some soon still such takes than that the their them then there these they this those three through to today too took two under until up upon us used very visitors wants was we went were what when where which while who whom why will with would write wrote yes yet you your engineers order passport tax lot gate hash gauge section paragraph chapter see use part invoice flight insured bill mail ask text missed pick regards thanks ok done can budget main rose short complaint plans exchange user session context perhaps planned trip".split()
)
#: Common short forms of given names, which lists often lack.
SHORT_FORMS = "Nick Bill Bob Dick Ned Ted Judy Hilde Fred Tom Jim Joe Kate Liz Beth Meg Peggy Polly Molly Dan Dave Mike Steve Chris Pat Ron Ray Ken Len Jeff Jerry Harry Hal Jack Sandy Sue Maggie Betty Bess Tess Connie Mandy Millie Winnie Lizzie Katie Rosie Susie Vicky Frankie Charlie Eddie Freddie Ronnie Vince Walt Gus Nat Toni Franz Hans Fritz Heinz Uwe Pepe Nacho Lola Conchita Gigi Pino Toto".split()
#: Short forms that are words, too: only capitalised they count as names.
_WORDS = {n.lower() for n in SHORT_FORMS} | {"art", "ben", "cass", "clem", "des", "dick", "etta", "genie", "kit", "mal", "matt", "max", "memo", "mira", "nate", "penny", "perry", "reg", "sam", "tim", "tony", "viv", "lena", "lino", "will", "mark", "rose", "grace", "hope", "joy", "faith", "may", "june", "april", "bill", "bob", "jack", "dora", "nora", "flora", "alf", "bert", "sukie"}
_BASE = {c: b for c in range(0xC0, 0x250) if len(b := unicodedata.normalize("NFKD", chr(c))[0]) == 1 and b.isascii()}


def _lowered(text: str) -> str:
    """Lower case without accents, of the same length."""
    if text.isascii():
        return text.lower()
    t = text.translate(_BASE)
    low = t.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)


class Finder:
    """Finds personal information, with a list of given names (and their short forms)."""

    def __init__(self, names: list[str]):
        import ahocorasick

        self.names = ahocorasick.Automaton()
        for n in sorted({_lowered(n) for n in [*names, *SHORT_FORMS] if n and len(n) > 2}):
            self.names.add_word(n, n)
        self.any = len(self.names) > 0
        if self.any:
            self.names.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type) of each item, in order, without overlap."""
        out: list[tuple[int, int, str]] = []

        def take(spans: Iterator[tuple[int, int]], kind: str) -> None:
            nonlocal text
            parts, last = [], 0
            for a, z in spans:
                if z > a and a >= last and "\0" not in text[a:z]:
                    out.append((a, z, kind))
                    parts += [text[last:a], "\0" * (z - a)]
                    last = z
            if parts:
                text = "".join([*parts, text[last:]])

        if "@" in text or re.search(r"\b(?:at|dot)\b", text, re.I):
            take((m.span() for m in EMAIL.finditer(text)), "email")
        if re.search(r"\d", text):
            take((m.span() for m in ADDRESS.finditer(text)), "address")
            take((m.span() for m in ID_NUMBER.finditer(text)), "id_number")
            take((m.span() for m in PHONE.finditer(text) if 7 <= sum(c.isdigit() for c in m[0]) <= 17), "phone")
            take((m.span(1) for m in ID_CUE.finditer(text) if sum(c.isdigit() for c in m[1]) >= 5), "id_number")
        take(self._people(text), "name")
        return sorted(out)

    def _people(self, text: str) -> Iterator[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        low = _lowered(text)
        for end, name in self.names.iter(low) if self.any else ():
            a, z = end - len(name) + 1, end + 1
            if (a and (low[a - 1].isalnum() or low[a - 1] in "_@\0")) or (z < len(low) and (low[z].isalnum() or low[z] in "_@\0")):
                continue
            given = text[a:z]
            if given.islower() and name in _WORDS:
                continue
            m = _AFTER.match(text, z) or (_AFTER.match(text, z + 1) if text[z : z + 1] == "." else None)
            if m and self._surname(given, m[1], text, m.end()):
                found.append((a, m.end()))
            elif (m := _BEFORE.search(text, max(0, a - 40), a)) and self._surname(given, m[1], text, z):
                found.append((m.start(), z))
        for m in _TITLED.finditer(text):
            words = re.findall(_NAME, m[1])
            if words and words[0].lower() not in COMMON and (words[0][0].isupper() or len(words[0]) > 4):
                second = len(words) > 1 and (words[1].lower() in COMMON or words[1][0].islower() != words[0][0].islower() or words[1].lower() in ORGANISED)
                found.append((m.start(), m.end() - (len(m[1]) - m[1].rindex(words[1]) + 1 if second else 0)))
        found += [m.span() for m in _INITIAL.finditer(text) if m[1].lower() not in COMMON]
        found += [m.span(1) for m in _SMALL_INITIAL.finditer(text) if m[2].lower() not in COMMON]
        for m in (*_CUED.finditer(text), *_SIGNED.finditer(text)):
            n = _NEXT.match(text, m.end())
            if m[1].split()[0].lower() not in COMMON and m[2].lower() not in COMMON | ORGANISED and not (n and n[1].lower() in ORGANISED):
                found.append(m.span(1))
        last = -1
        for a, z in sorted(found, key=lambda s: (s[0], -s[1])):
            if a >= last:
                yield a, z
                last = z

    @staticmethod
    def _surname(given: str, word: str, text: str, end: int) -> bool:
        w = word.lower().removesuffix("'s").removesuffix("’s")
        if w in COMMON or w in ORGANISED or len(w) < (4 if given.islower() or given.isupper() else 2):
            return False
        if given[0].isupper() and word[0].islower() or given[0].islower() and not word.islower():
            return False
        n = _NEXT.match(text, end)
        return not (n and n[1].lower() in ORGANISED)

    def redact(self, text: str, key: bytes) -> tuple[str, list[str]]:
        """The text with placeholders and their types: numbers and birth dates permuted within their format, the rest by a keyed tag."""
        out, last = [], 0
        spans = self.find(text)
        dates = [m.span(1) for m in _BIRTH.finditer(text)]
        ends = sorted(spans)
        for a, z in dates:
            i = bisect.bisect_left(ends, (z,))
            if not i or ends[i - 1][1] <= a:
                spans.append((a, z, "date"))
        for a, z, kind in sorted(spans):
            value = text[a:z]
            if kind in ("phone", "id_number"):
                shown = pseudonym(value, key, kind)
            elif kind == "date":
                shown = pseudonym_of_date(value, key) or re.sub(r"\w", "0", value)
            else:
                plain = re.sub(r"\W+", " ", re.sub(r"\s*[\[({<]?\s*\b(?:at|dot)\b\s*[\])}>]?\s*", " ", _lowered(value)) if kind == "email" else _lowered(value)).strip()
                plain = " ".join(sorted(plain.split())) if kind == "name" else plain
                shown = hmac.new(key, f"{kind}|{plain}".encode(), hashlib.sha256).hexdigest()[:32]
            out += [text[last:a], f"[{kind.upper()}:{shown}]"]
            last = z
        return "".join([*out, text[last:]]), sorted({k for _, _, k in spans})


_CONTENT = re.compile(r'"content"\s*:\s*"((?:[^"\\]|\\.)*)')


def contents(messages: str | None) -> list[str]:
    """The contents of a JSON array of messages by place; of an array that is cut off, those that are there."""
    if not messages:
        return []
    try:
        parsed = json.loads(messages)
        return [str(m.get("content") or "") if isinstance(m, dict) else str(m or "") for m in parsed] if isinstance(parsed, list) else []
    except ValueError:
        out = []
        for raw in _CONTENT.findall(messages):
            raw = re.sub(r"\\(?:u[0-9a-fA-F]{0,3})?$", "", raw)
            try:
                out.append(json.loads(f'"{raw}"', strict=False))
            except ValueError:
                out.append(raw)
        return out


def _rows(texts: Iterator[tuple]) -> Iterator[tuple[str, int, str, int, str]]:
    for src, row_id, field, text in texts:
        for pos, part in enumerate(contents(text)) if field == "messages" else ((0, text),):
            if part:
                yield src, row_id, field, pos, part


def redact_personal(texts: DataFrame, names: list[str], key: bytes) -> DataFrame:
    """(src, row_id, field, pos, text, kinds): the texts with typed placeholders, and the types of these.

    texts has src, row_id, field and text; where field is `messages`, text is a JSON array of messages and each
    content is a text of its own (pos is its place, else 0). names are given names with short forms, at most some
    100,000.

    Format-preserving Feistel pseudonyms: numbers that have a known format (or a word before them that says what they
    are) and birth dates in any notation are permuted within their format by `key`, other values get a keyed tag of 128
    bits, so equal values stay linked across documents and nobody without the key can tell what they were.
    Numbers are found by their format or by what is said before them, streets by their type and house number,
    persons by a given name, title or initial together with a surname; e-mail addresses, also disguised ones, and
    streets are taken out before persons are looked for. The whole text is read.

    Defined cases: null and empty texts and arrays that aren't JSON have no rows; of an array that is cut off,
    the contents that are there count; repeated rows come out once for each; a text without personal information comes
    out as it is; an empty key is an error; other columns play no part.
    """
    if not key:
        raise ValueError("pseudonyms need a key")

    def redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(names)
        for b in batches:
            rows = [(*head, *finder.redact(part, key)) for *head, part in _rows(zip(b["src"], b["row_id"], b["field"], b["text"]))]
            yield pd.DataFrame(rows, columns=["src", "row_id", "field", "pos", "text", "kinds"])

    return texts.select("src", "row_id", "field", "text").where("text is not null and text <> ''").mapInPandas(redact, "src string, row_id bigint, field string, pos bigint, text string, kinds array<string>")


def find_personal(texts: DataFrame, names: list[str], key: bytes) -> DataFrame:
    """(src, row_id, field, pos, pii_type): each type of placeholder that redact_personal puts into each text, once.

    Types: email, phone, id_number, address, name. Cases as in redact_personal.
    """
    found = redact_personal(texts, names, key)
    return found.select("src", "row_id", "field", "pos", F.explode("kinds").alias("pii_type")).where("pii_type <> 'date'")


def given_names(names: DataFrame, most: int = 50_000) -> list[str]:
    """Given names and short forms of a dictionary table, which must have at most `most`."""
    rows = names.select(F.explode(F.array("given", "short_form")).alias("n")).where("n is not null and n <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} given names")
    return sorted(r[0] for r in rows)
