"""Personal data in texts, also where it is disguised.

Plain e-mail addresses, IP addresses, card and telephone numbers are found by linear scans. For disguises, small
transducers rewrite a text and keep, for every piece of the result, where in the source it came from:
homoglyphs and digits of other scripts become ASCII one by one; characters without width vanish; in what that gives,
spelled digits become digits; "(at)", "[dot]", "name at host dot tld" become @ and dots, each on its own too. Identifiers found in the rewritten text are
mapped back to source positions. A span of the base kinds always stays; a rewritten one is added where no base span of
its kind holds it.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import add_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ from each @, so that a long run without one costs nothing."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return found


def ips(text: str) -> list[Span]:
    """[0-9]+(\\.[0-9]+){3} with parts to 255: each four parts of a dotted run, in order."""
    found = []
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def base(text: str) -> list[tuple[str, int, int]]:
    """The base spans of a text, by kind and start."""
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    found += [("ip", *x) for x in ips(text)]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return found


# ---- transducers -------------------------------------------------------------------------------------------------

#: Letters of other scripts that look like a Latin letter, in pairs.
LOOKALIKES = "аaеeоoрpсcуyхxіiјjѕsԁdһhкkАAВBЕEКKМMНHОOРPСCТTХXІIЈJЅSοoαaεeιiκkνvρpΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX․.。.﹫@"
SAME = dict(zip(map(ord, LOOKALIKES[::2]), LOOKALIKES[1::2], strict=True))
SAME |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full width
SAME |= {c: str(d) for c in range(128, sys.maxunicode) if (d := unicodedata.decimal(chr(c), None)) is not None}
ONE_TO_ONE = re.compile("[" + "".join(map(chr, sorted(SAME))) + "]")

#: Spelled digits in the four languages of the documents; fixed values.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "un": "1",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
DIGIT_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
def latin(text: str) -> bool:
    """Whether all characters are in Latin-1, where nothing looks like something else."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


BRACKETED = r"[\[({<][ \t]*+(?:dot|point|\.)[ \t]*+[\])}>]"
ITEM = rf"(?:{DIGIT_WORD}(?!\w)|[0-9]++)"
#: Digits and spelled digits between gaps and dots, disguised ones too.
NUMBER_RUN = re.compile(
    rf"(?:(?:\+|(?<!\w)plus)[ \t]?)?(?:(?<!\w){DIGIT_WORD}(?!\w)|(?<![0-9])[0-9]++)"
    rf"(?:[ \t]{{0,3}}{BRACKETED}[ \t]{{0,3}}{ITEM}|[ \t\n,.()-]{{1,3}}(?:{ITEM}|(?:dot|point)(?!\w)))+",
    re.IGNORECASE,
)
NUMBER_PART = re.compile(rf"(?P<sign>\+)|(?P<plus>plus)|(?P<dot>[ \t]*{BRACKETED}[ \t]*|dot|point)|(?P<word>{DIGIT_WORD})|(?P<number>[0-9]+)|(?P<gap>[ \t\n,.()-]+)", re.IGNORECASE)
#: Digit words from which on all gaps of a run are dropped, those between plain numbers too.
MOSTLY_SPELLED = 3
#: After "plus" a sum in groups of three digits and no telephone number.
GROUPED = re.compile(r"plus[ \t]?[0-9]{1,3}(?:[ ,.][0-9]{3})+", re.IGNORECASE)

AT = re.compile(r"[\[({<][ \t]?(?:[aA][tT]|@)[ \t]?[\])}>]|[ \t][aA][tT][ \t]|@")
DOT = r"(?:[ \t]*[\[({<][ \t]*(?:dot|\.)[ \t]*[\])}>][ \t]*|[ \t]+dot[ \t]+)"
HOST = re.compile(rf"[A-Za-z0-9-]+(?:(?:{DOT}|\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
DOTS = re.compile(DOT, re.IGNORECASE)
#: A disguised dot without the blanks around it.
BARE_DOT = re.compile(r"[\[({<][ \t]*+(?:dot|\.)[ \t]*+[\])}>]|(?<=[ \t])dot(?=[ \t])", re.IGNORECASE)
#: "name at host.end" has nothing but a plain "at" to tell it from prose ("he came at noon.It rained"). It counts at these
#: ends, or, at any end of letters, where the name has a digit, a dot or the like inside, or a word for mail stands before it.
ENDS = re.compile(r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|eu|uk)\Z", re.IGNORECASE)
LETTERS_END = re.compile(r"\.[A-Za-z]{2,}\Z")
NO_WORD = re.compile(r"[A-Za-z]+[0-9._%+-]+[A-Za-z0-9]|[0-9]+[A-Za-z]")
MAIL_WORD = re.compile(r"(?<!\w)(?:e-?mails?|mail|contact|reach|write to|address|courriel|contacter|kontakt|schreiben an|correo|escriba a)(?: is| me| us| an| a| à)?[ \t]*[:=]?[ \t]*\Z", re.IGNORECASE)
NO_WIDTH = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]+")


class Rewritten:
    """A text in pieces, each with its place in the source; a copied piece maps character by character, another as a whole."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.at, self.size = [], 0
        self.source: list[tuple[int, int, bool]] = []

    def add(self, piece: str, start: int, end: int, copied: bool) -> None:
        if piece:
            self.parts.append(piece)
            if copied and self.source and self.source[-1][1:] == (start, True):
                self.source[-1] = (self.source[-1][0], end, True)
            else:
                self.at.append(self.size)
                self.source.append((start, end, copied))
            self.size += len(piece)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of a span here, and whether a rewritten piece is in it or something between copied ones was left out."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first, last = self.source[i], self.source[j]
        return (
            first[0] + (start - self.at[i] if first[2] else 0),
            last[0] + (end - self.at[j]) if last[2] else last[1],
            not all(x[2] for x in self.source[i : j + 1]) or i != j,
        )


def numbers(text: str) -> list[Rewritten]:
    """Runs of digits with spelled ones or disguised dots among them, rewritten.

    A gap between plain numbers stays, for the base checks to judge; one beside a rewritten piece goes, or is a dot.
    """
    out = []
    for m in NUMBER_RUN.finditer(text):
        parts = [(p.lastgroup, *p.span()) for p in NUMBER_PART.finditer(text, *m.span())]
        kinds = [k for k, _, _ in parts]
        words = kinds.count("word")
        if not words and "dot" not in kinds and ("plus" not in kinds or GROUPED.fullmatch(m[0])):
            continue
        for whole in (False, True) if words >= MOSTLY_SPELLED else (False,):
            run = Rewritten()
            for i, (kind, a, b) in enumerate(parts):
                if kind == "word":
                    run.add(SPELLED[text[a:b].lower()], a, b, False)
                elif kind == "plus":
                    run.add("+", a, b, False)
                elif kind == "dot":
                    run.add(".", a, b, False)
                elif kind == "gap":
                    beside = kinds[i - 1 : i] + kinds[i + 1 : i + 2]
                    if not whole and all(k in ("number", "sign") for k in beside):
                        run.add(text[a:b], a, b, True)
                    elif "." in text[a:b] and "dot" not in beside:
                        run.add(".", a, b, False)
                else:
                    run.add(text[a:b], a, b, True)
            out.append(run)
    return out


def name_start(text: str, left: int, dots: dict[int, int]) -> int:
    """Where the name that ends at left begins; its dots may be disguised ones, given by their ends."""
    start = left
    while True:
        while start > 0 and text[start - 1] in LOCAL:
            start -= 1
        before = dots.get(start, 0)
        if start == left or before == 0 or text[before - 1] not in LOCAL:
            return start
        start = before


def addresses(text: str) -> list[Rewritten]:
    """Addresses with a disguised @, or a plain one beside disguised dots, rewritten."""
    out: list[Rewritten] = []
    ends: dict[int, int] | None = None
    for m in AT.finditer(text):
        if ends is None:
            ends = {}
            for d in BARE_DOT.finditer(text):
                a, b = d.span()
                while a > 0 and text[a - 1] in " \t":
                    a -= 1
                while b < len(text) and text[b] in " \t":
                    b += 1
                ends[b] = a
        if m[0] == "@" and not ends:
            continue
        left, right = m.span()
        if m[0] != "@":
            while left > 0 and text[left - 1] in " \t":
                left -= 1
            while right < len(text) and text[right] in " \t":
                right += 1
        host = HOST.match(text, right)
        if not host or left == 0 or text[left - 1] not in LOCAL:
            continue
        start = name_start(text, left, ends)
        plain = m[0].strip(" \t").lower() == "at"
        if plain and not DOTS.search(host[0]) and not ENDS.search(host[0]):
            told = NO_WORD.match(text, start, left) or MAIL_WORD.search(text, max(0, start - 24), start)
            if not told or not LETTERS_END.search(host[0]):
                continue
        run = Rewritten()
        for a, b in ((start, left), (left, right), host.span()):
            if a == left:
                run.add("@", a, b, m[0] == "@")
                continue
            for d in DOTS.finditer(text, a, b):
                run.add(text[a : d.start()], a, d.start(), True)
                run.add(".", *d.span(), False)
                a = d.end()
            run.add(text[a:b], a, b, True)
        out.append(run)
    return out


def disguised(text: str) -> set[tuple[str, int, int]]:
    """Spans of identifiers that only a rewritten text shows. Later rewritings read what the earlier ones made."""
    found: set[tuple[str, int, int]] = set()
    flat, shown = text, None
    if "\xad" in text or not latin(text):
        if ONE_TO_ONE.search(text):
            flat = text.translate(SAME)
            found.update(base(flat))
        if NO_WIDTH.search(flat):
            shown, a = Rewritten(), 0
            for m in NO_WIDTH.finditer(flat):
                shown.add(flat[a : m.start()], a, m.start(), True)
                a = m.end()
            shown.add(flat[a:], a, len(flat), True)
            flat = "".join(shown.parts)
            for kind, s, e in base(flat):
                s, e, changed = shown.back(s, e)
                if changed:
                    found.add((kind, s, e))
    for run in addresses(flat) + numbers(flat):
        for kind, s, e in base("".join(run.parts)):
            s, e, changed = run.back(s, e)
            if changed:
                found.add((kind, *shown.back(s, e)[:2]) if shown else (kind, s, e))
    return found


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans of a text by kind and start; true where the span is a base one."""
    if not text:
        return []
    plain = base(text)
    more = disguised(text).difference(plain)
    if more and plain:  # base spans of a kind don't overlap: only the last one that begins before a span can hold it
        starts = {k: [x[1] for x in plain if x[0] == k] for k in KINDS}
        ends = {k: [x[2] for x in plain if x[0] == k] for k in KINDS}
        more = {x for x in more if not (i := bisect_right(starts[x[0]], x[1])) or ends[x[0]][i - 1] < x[2]}
    return sorted([(*x, True) for x in plain] + [(*x, False) for x in more], key=lambda x: (KINDS.index(x[0]), *x[1:]))


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
)


def find(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """df with the spans of personal data in a text column, in code points, end exclusive.

    A null or empty text has none. Other columns and repeated rows stay; one named like `out` is replaced.
    """

    def make(texts: list) -> list:
        return [[[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in spans(x)] for x in texts]]

    return add_columns(df, text, [T.StructField(out, SPANS)], make)


def masked(text: str | None) -> str | None:
    if not text:
        return text
    out, done = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e, _ in spans(text)):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each found span replaced by its kind's name; of spans that overlap, the first one's. Null stays null."""
    order = df.columns
    return add_columns(df, text, [T.StructField(text, T.StringType())], lambda texts: [list(map(masked, texts))]).select(*(f"`{c}`" for c in order))


def digest(documents: DataFrame) -> DataFrame:
    """For each document the number of base spans of each kind, their hash, and all spans in text form."""
    joined = lambda which: F.array_join(F.transform(which, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    plain = F.filter("pii", lambda x: x.base)
    number = lambda kind: F.size(F.filter("pii", lambda x: x.base & (x.kind == kind))).cast("long")
    return find(documents.select("doc_id", "text")).select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(plain).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.size(F.filter("pii", lambda x: ~x.base)).cast("long").alias("n_added"),
    )
