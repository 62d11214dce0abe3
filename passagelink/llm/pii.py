"""Personal information inside free text: typed spans and redaction."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "person")
#: A kind beside them: payment card and bank account numbers, which their check digits alone tell.
ACCOUNT = "account"
#: Score at which a proposed span counts.
ENOUGH = 2

# Characters that are laid aside or made alike before matching; all other text stays as it is.
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF, *range(0x202A, 0x202F), *range(0x2066, 0x206A)])
_ALIKE = {
    **dict.fromkeys([0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], " "),
    **dict.fromkeys([*range(0x2010, 0x2016), 0x2212, 0xFE63, 0xFF0D], "-"),
    **{c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if c != 0xFF0D},
    0x2018: "'", 0x2019: "'", 0x2215: "/", 0x2044: "/",
}
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in [*_INVISIBLE, *_ALIKE]) + "]")
_HIDDEN = re.compile("[" + "".join(map(chr, _INVISIBLE)) + "]")

# --- mail addresses
_LABEL = r"[^\W_](?:[\w\-]*[^\W_])?"
_LOCAL = r"[^\W](?:[\w.+\-%]*\w)?"
_DOT = r"(?:\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+|\.)"
_MAIL = re.compile(
    rf"(?<![\w.+\-%])(?P<v>{_LOCAL}(?:\s+dot\s+{_LOCAL})*(?:\s?@\s?|\s?[\[({{]\s?(?:at|@)\s?[\])}}]\s?|&#64;|%40){_LABEL}(?:{_DOT}{_LABEL})+"
    rf"|{_LOCAL}(?:\s+dot\s+{_LOCAL})*\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL})+)(?![\w@])"
)
_MAIL_HINTS = ("@", "&#64;", "%40", "[at", "(at", "{at", "[ at", "( at", " dot ", "\ndot ", " dot\n")

# --- numbers
_S = r"[\s.\-/]"
# strong shapes: an international prefix with its country code; groups of three, three and four digits whose first is no
# 0 or 1; a trunk 0 with groups set off by a dash, a slash or single digits
_PHONE = re.compile(
    rf"(?<![\w.+\-/])(?P<v>(?P<strong>(?:\+\s?|\b00)[1-9]\d{{0,2}}{_S}?(?:\(0\){_S}?)?\(?\d{{1,4}}\)?(?:{_S}{{0,2}}\d{{2,8}}){{1,4}}"
    rf"|\b0\d{{2,4}}-\d{{6,8}}|\b0\d{{2,4}}\s?/\s?\d\d(?:\s?\d\d){{2,3}}|\b0(?:\s\d){{9,10}}"
    rf"|(?:\([2-9]\d\d\)|[2-9]\d\d){_S}?[2-9]\d\d{_S}?\d{{4}})"
    rf"|[+(]?\d(?:[\s().\-/]{{0,3}}\d){{6,13}})(?![\w/]|-\d|\.\d)"
)
_CALL = re.compile(
    r"(?i:(?:number\s+is|text\s+me\s+(?:on|at)|erreichbar\s+unter|ring|call|(?:tele)?phone|telefon|tel|telefax|fax|mobile?|mobil|handy|cell|whatsapp)\s*[.:=]?\s*(?:no\.?\s*)?|\bT\s|[☎☏✆📞]\s*)$"
)
_NOT_PERSONAL = re.compile(r"(?i:(?:inventory|inventar|lot|los|shelf\s?mark|signatur|checksum|prüfsumme|cat\.\s*no\.|part\s*no\.|isbn|issn|order|invoice|folio|run|token|rank|version|dated|pp\.|see\s+col)\W*)$")
# a number of letters and digits: pieces joined by dashes or slashes, or short groups set apart by single blanks
_NUMBER = (
    r"(?P<v>[A-Z]\d{2}\s[A-Z]{2}\d{4}|\d{2,4}(?:\s\d{2,4}){2,4}|[A-Z]{0,3}\d{2,12}[A-Z]{0,2}|[A-Z]{0,4}\d{0,6}(?:[-/][A-Z]{0,2}\d{1,8}[A-Z]?){1,3}(?:-[A-Z])?)(?![\w/]|-[\dA-Z])"
)
_CARD = re.compile(
    r"(?i:\b(?:id\s?card|identity\s+card|social\s+security|(?:national\s+)?(?:identity|insurance)\s+number|passport|tax\s+(?:number|id)|ssn|driving\s+licen[cs]e|driver'?s?\s+licen[cs]e|licen[cs]e"
    r"|personalausweis|ausweis|steuer(?:nummer|-?id)|reisepass|führerschein|sozialversicherungsnummer)(?:[\s-]*(?:no|nr|number|nummer)\.?)?(?:\s+(?:given\s+)?(?:was|is|lautet))?\s*[:=#]?\s*)"
    + _NUMBER
)
# words that name a number of a person less surely; only a right check digit lifts what follows them
_HINTED = re.compile(r"(?i:\b(?:id|ident(?:ity|ification)?|national|personal|citizen|nhs|sin|bsn|nif|cpf|pesel|personnummer)(?:[\s-]*(?:no|nr|id|number|nummer))?\.?\s*[:=#]?\s*)" + _NUMBER)
_ACCOUNT = re.compile(r"(?<![\w\-/.])(?P<v>(?P<iban>[A-Z]{2}\d{2}(?:\s?[A-Z\d]{4}){2,7}(?:\s?[A-Z\d]{1,3})?)|[3-6]\d{3}(?:[\s\-]?\d{4}){2}[\s\-]?\d{1,7}|3\d{3}[\s\-]?\d{6}[\s\-]?\d{5})(?![\w/]|-\d)")

_CARD_HINTS = ("card", "security", "identity", "insurance", "passport", "tax ", "tax\n", "ssn", "licen", "ausweis", "steuer", "reisepass", "führerschein", "versicherung")

# --- addresses
_W = r"[^\W\d_](?:[^\W\d_]|[̀-ͯ'])*"
_NO = r"\d{1,4}\s?[a-hA-H]?(?!\w)"
_UNIT = r"(?i:flat|apt\.?|apartment|unit|wohnung|whg\.?|suite|room)"
_END = rf"(?:,\s{_UNIT}\s\d{{1,4}}[a-z]?\b)?"
# a house number before its street, a street by its last word before a house number, a street by its first
_STREETS = (
    re.compile(
        rf"(?<![\w.])(?P<v>(?:{_UNIT}\s\d{{1,4}}[a-z]?,\s)?\d{{1,4}}\s?[a-hA-H]?(?!\w),?\s(?:rue\s(?:(?:des?|du|la)\s)?{_W}|RUE\s(?:(?:DES?|DU|LA)\s)?{_W}"
        rf"|(?:[Oo]ld\s|OLD\s)?{_W}\s(?i:street|road|avenue|hill|close|row|lane|way|drive|square|court|st\b\.?|rd\b\.?|ave\b\.?|ln\b\.?|dr\b\.)){_END})(?!\w)"
    ),
    re.compile(rf"(?<![\w.])(?P<v>(?:[Aa]m|AM)\s{_W}(?i:berg)\s{_NO})(?!\w)"),
)
_ENDS = ("straße", "strasse", "str.", "gasse", "weg", "platz", "allee")
_GERMAN = re.compile(rf"(?i:{'|'.join(map(re.escape, _ENDS))})\s{_NO}{_END}(?!\w)")
_ENDS_HINTS = tuple(f"{e} " for e in _ENDS)
# five digits near each other; no number that counts is without
_FIVE = re.compile(r"\d(?:[\s().\-/A-Z]{0,3}\d){4}")

# --- names
_UP = "A-ZÀ-ÖØ-Þ" + "".join(chr(c) for c in range(0x100, 0x250) if chr(c).isupper())
_N = rf"[{_UP}](?:[^\W\d_]|[̀-ͯ])+(?:'[{_UP}](?:[^\W\d_]|[̀-ͯ])+)?"
_I = rf"[{_UP}][̀-ͯ]?\."
_PARTICLE = r"(?:(?:von|van|de|der|den|al|el|bin|ibn|la|du|di|da|zu|ter|ten)\s)*"
_FAMILY = rf"{_N}(?:-{_N})*"
_NAME = rf"(?:{_N}(?:-{_N})?\s(?:{_I}\s){{0,2}}{_PARTICLE}{_FAMILY}|{_FAMILY},\s{_N}(?:\s{_I})?|(?:{_I}\s?){{1,3}}\s?{_PARTICLE}{_FAMILY})"
_TITLE = r"(?:(?i:dr|prof|mr|mrs|ms|herr|herrn|frau|sir|dame|rev|fr)\b\.?\s)"
_LED_HINTS = (
    "contact", "name is", "ich heiße", "reviewer", "author", "signed", "signiert", "geprüft", "reviewed", "checked", "thanks", "dank", "colleague", "kolleg", " met", "geehrte", "liebe", "dear",
    "dr ", "dr.", "prof ", "prof.", "mr ", "mr.", "mrs ", "mrs.", "ms ", "ms.", "herr", "frau", "sir ", "sir.", "dame ", "dame.", "rev ", "rev.", "fr ", "fr.",
)
_LED = re.compile(
    rf"(?:(?i:\b(?:contact\s+person|reviewer|author|signed|signiert|geprüft\s+von|reviewed\s+by|checked\s+by|(?:my|his|her|whose)\s+name\s+is|ich\s+heiße|thanks\s+to|dank\s+an|my\s+colleague|meine?\s+kolleg(?:e|in)|i\s+met|sehr\s+geehrte[r]?)[\"']?\s?[:=,]?\s?[\"']?){_TITLE}*|\b{_TITLE}+|(?i:\b(?:dear|liebe[r]?)\s)(?!\w+,))"
    rf"(?P<v>{_NAME})"
)
_FOLLOWED = re.compile(
    rf"(?P<v>{_NAME})(?:'s?\s(?:notes|papers|letters?|copy|copies|notebook|desk|collation|hand)\b|\s(?i:disagrees\s+with|pointed\s+out|kept\s+the\s+original|has\s+seen\s+the|wrote\s+to\s+us|agrees\s+with)\b)"
)
_FOLLOWED_HINTS = ("'s ", "'s\n", "disagrees", "pointed", "kept the", "kept\nthe", "seen the", "seen\nthe", "wrote to us", "agrees with")
_ABOVE = re.compile(rf"(?:^|(?<![\w\-]))(?P<v>{_NAME})\s*[\r\n]\s*$")
_PAIR = re.compile(rf"(?<![\w\-])(?P<v>(?P<a>{_N}),?\s(?:{_I}\s)?(?P<b>{_N}))(?![\w\-])")


class Span(NamedTuple):
    kind: str
    begin: int
    end: int


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    at = [int(c) for c in reversed(digits)]
    return bool(at) and sum(at[0::2] + [sum(divmod(2 * d, 10)) for d in at[1::2]]) % 10 == 0


def mod97(number: str) -> bool:
    """Whether letters and digits, the letters as 10 to 35, leave 1 when divided by 97 (ISO 7064)."""
    return number.isalnum() and number.isascii() and int("".join(str(int(c, 36)) for c in number)) % 97 == 1


def mod11_10(digits: str) -> bool:
    """Whether the last digit is the check digit of the others by ISO 7064 mod 11,10."""
    p = 10
    for c in digits[:-1]:
        p = ((p + int(c)) % 10 or 10) * 2 % 11
    return len(digits) > 1 and (11 - p) % 10 == int(digits[-1])


def weighted11(digits: str) -> bool:
    """Whether the digits, weighted by their places from the right, sum to a multiple of 11."""
    return len(digits) > 1 and sum(k * int(c) for k, c in enumerate(reversed(digits), 1)) % 11 == 0


def checked(number: str) -> bool:
    """Whether a number of a person carries a right check digit by a scheme of its length."""
    d = _digits(number)
    if len(d) in (9, 10) and len(set(d)) > 1:
        return luhn(d) or weighted11(d)
    return len(d) == 11 and len(set(d)) > 1 and mod11_10(d) or len(d) >= 12 and mod97(number)


def value(piece: str) -> str:
    """The piece in lower case, letters and digits only."""
    return "".join(c for c in piece.lower() if c.isalnum())


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _has(low: str, hints: tuple[str, ...]) -> bool:
    return any(h in low for h in hints)


def _streets(t: str, low: str) -> Iterator[tuple[int, int]]:
    """Streets with house numbers anywhere in a text."""
    for pattern in _STREETS:
        for m in pattern.finditer(t):
            yield m.span("v")
    for m in _GERMAN.finditer(t) if _has(low, _ENDS_HINTS) else ():
        # the word that ends here
        begin = m.start()
        while begin and (t[begin - 1].isalpha() or unicodedata.combining(t[begin - 1]) or t[begin - 1] == "'"):
            begin -= 1
        if begin == m.start() and t[begin].isupper() and begin > 1 and t[begin - 1] in " -":  # of two words
            begin -= 1
            while begin and t[begin - 1].isalpha():
                begin -= 1
            if not t[begin].isupper():
                continue
        if begin < m.start() and t[begin].isalpha() and not (begin and (t[begin - 1] == "." or t[begin - 1].isalnum() or t[begin - 1] == "_")):
            yield begin, m.end()


def _lines_up(t: str, at: int, n: int) -> int:
    """Where the n-th line of some text before a place begins."""
    for _ in range(n):
        while at and t[at - 1].isspace():
            at -= 1
        at = max(t.rfind("\n", 0, at), t.rfind("\r", 0, at)) + 1
    return at


def _spans(t: str, given: frozenset[str], family: frozenset[str]) -> Iterator[Span]:
    """Proposed spans that score enough, on text without odd characters."""
    # of the same length; any white space is a blank in the hints
    low = re.sub(r"\s", " ", t.lower())
    if _has(low, _MAIL_HINTS):
        for m in _MAIL.finditer(t):
            yield Span("email", *m.span("v"))
    taken = []
    many = _FIVE.search(t)
    for m in _ACCOUNT.finditer(t) if many else ():
        # the check digits of these decide alone
        number = value(m["v"]).upper()
        if _NOT_PERSONAL.search(t[max(0, m.start() - 28) : m.start()]):
            continue
        if mod97(number[4:] + number[:4]) if m["iban"] else luhn(number) and len(set(number)) > 1:
            taken.append(m.span("v"))
            yield Span(ACCOUNT, *m.span("v"))
    for weight, pattern in ((2, _CARD), (1, _HINTED)):
        for m in pattern.finditer(t) if many and (weight == 1 or _has(low, _CARD_HINTS)) else ():
            a, b = m.span("v")
            number = m["v"]
            if len(value(number)) < 7 or len(_digits(number)) < 5 or any(x < b and a < y for x, y in taken):
                continue
            # the words before a number weigh, and a right check digit adds to them
            taken.append((a, b))
            if weight + checked(number) >= ENOUGH:
                yield Span("id_number", a, b)
    for m in _PHONE.finditer(t) if many else ():
        a, b = m.span("v")
        if not 7 <= len(_digits(m["v"])) <= 15 or any(x < b and a < y for x, y in taken):
            continue
        before = t[max(0, a - 28) : a]
        score = 2 * bool(m["strong"]) + 2 * bool(_CALL.search(before)) - 3 * bool(_NOT_PERSONAL.search(before))
        if score >= ENOUGH:
            yield Span("phone", a, b)
    for begin, end in _streets(t, low):
        yield Span("address", begin, end)
        # a line above a street, or two, is the name of who lives there
        if above := _ABOVE.search(t, _lines_up(t, begin, 2), begin):
            yield Span("person", *above.span("v"))
    if _has(low, _LED_HINTS):
        for m in _LED.finditer(t):
            yield Span("person", *m.span("v"))
    if _has(low, _FOLLOWED_HINTS):
        for m in _FOLLOWED.finditer(t):
            yield Span("person", *m.span("v"))
    if given:
        for m in _PAIR.finditer(t):
            a, b = m["a"].casefold(), m["b"].casefold()
            if a in given and b in family or a in family and b in given:
                yield Span("person", *m.span("v"))


def find(text: str, given: frozenset[str] = frozenset(), family: frozenset[str] = frozenset()) -> list[Span]:
    """The spans of personal information of a text, in order and without overlap, a longer span before a shorter one."""
    at = None
    t = text
    if _ODD.search(t):
        if _HIDDEN.search(t):
            at = [i for i, c in enumerate(text) if ord(c) not in _INVISIBLE] + [len(text)]
            t = "".join(c for c in text if ord(c) not in _INVISIBLE)
        t = t.translate(_ALIKE)
    found = sorted(set(_spans(t, given, family)), key=lambda s: (s.kind in ("address", "person"), s.begin - s.end, s.begin))
    out: list[Span] = []
    for s in found:
        if not any(s.begin < o.end and o.begin < s.end for o in out):
            out.append(s)
    if at is not None:
        out = [Span(s.kind, at[s.begin], at[s.end - 1] + 1) for s in out]
    return sorted(out, key=lambda s: s.begin)


def redact(text: str, spans: list[Span]) -> str:
    """The text with a typed placeholder such as [EMAIL] in place of each span."""
    out, at = [], 0
    for s in spans:
        out += [text[at : s.begin], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join(out) + text[at:]


def _names(lexicon: list[tuple[str, str]]) -> tuple[frozenset[str], frozenset[str]]:
    of = lambda role: frozenset(p.casefold() for p, r in lexicon if p and r == role)
    return of("given"), of("family")


def find_pii(docs: DataFrame, ident: str, text: str, lexicon: list[tuple[str, str]] = ()) -> DataFrame:
    """The distinct pieces of personal information of every document. Columns out: ident, pii_kind, pii_value.

    Regular expressions propose spans of the five KINDS and of ACCOUNT. Words nearby raise or lower a span's score; check
    digits decide where words don't: numbers of cards and bank accounts count if Luhn or mod-97 holds, numbers that are
    only hinted at if a check digit of their length does. ``lexicon`` holds known (name part, role) pairs, a fixed list that need not be complete.
    ``pii_value`` is the piece in lower case, letters and digits only. Null, empty and blank texts give no rows; whole
    texts are searched, line by line breaks included; extra columns are dropped. One pass without a shuffle of texts.
    """
    given, family = _names(list(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {(d, s.kind, v) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for s in find(t, given, family) if (v := value(t[s.begin : s.end]))}
            yield pa.RecordBatch.from_pylist([dict(zip(("d", "k", "v"), r)) for r in sorted(rows)], pa.schema([("d", pa.int64()), ("k", pa.string()), ("v", pa.string())]))

    src = docs.select(F.col(ident).cast("bigint").alias("d"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    return src.mapInArrow(run, "d bigint, k string, v string").distinct().select(F.col("d").alias(ident), F.col("k").alias("pii_kind"), F.col("v").alias("pii_value"))


def redact_pii(docs: DataFrame, ident: str, text: str, lexicon: list[tuple[str, str]] = ()) -> DataFrame:
    """Every document with a typed placeholder in place of each piece of personal information. Columns out: ident, text, n_pii.

    One row for each row of ``docs``; a null text stays null. The rest of the text is kept character by character.
    """
    given, family = _names(list(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n = [], []
            for t in b.column(1).to_pylist():
                spans = find(t, given, family) if t else []
                texts.append(redact(t, spans) if spans else t)
                n.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int32())], ["d", "t", "n"])

    src = docs.select(F.col(ident).cast("bigint").alias("d"), F.col(text).alias("t"))
    return src.mapInArrow(run, "d bigint, t string, n int").select(F.col("d").alias(ident), F.col("t").alias("text"), F.col("n").alias("n_pii"))
