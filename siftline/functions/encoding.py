"""Texts whose bytes went wrong, letters with accents, and character references: all inside Spark's own functions.

Bytes are handled as hexadecimal digits, two to a byte, which patterns can tell apart; tables are built from the Unicode
data that Python carries, by rule.
"""

from __future__ import annotations

import html.entities
import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- bytes

_NEXT = "[89AB][0-9A-F]"
#: UTF-8 in hexadecimal digits: one sequence of two to four bytes.
SEQUENCE = (
    f"(?:C[2-9A-F]|D[0-9A-F]){_NEXT}|E0[AB][0-9A-F]{_NEXT}|E[1-9ABCEF]{_NEXT}{_NEXT}|ED[89][0-9A-F]{_NEXT}|F0[9AB][0-9A-F]{_NEXT}{_NEXT}|F[123]{_NEXT}{_NEXT}{_NEXT}|F48[0-9A-F]{_NEXT}{_NEXT}"
)
#: What one step reads: a run of ASCII, a sequence, or a byte that is neither. Runs have an end, as patterns may recurse on them.
STEP = f"(?:[0-7][0-9A-F]){{1,500}}|{SEQUENCE}|[0-9A-F][0-9A-F]"


def lossless(data: Column) -> Column:
    """Bytes as text: what is UTF-8 as such, and each byte that UTF-8 rejects as its Latin-1 letter. No byte is dropped, no word split."""
    def letter(step: Column) -> Column:
        lone = (F.length(step) == 2) & step.rlike("^[89A-F]")
        high = F.concat(F.lit("C3"), F.translate(F.substring(step, 1, 1), "CDEF", "89AB"), F.substring(step, 2, 1))
        return F.when(lone, F.when(step.rlike("^[89AB]"), F.concat(F.lit("C2"), step)).otherwise(high)).otherwise(step)

    steps = F.regexp_extract_all(F.hex(data), F.lit(STEP), F.lit(0))
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.decode(F.unhex(F.array_join(F.transform(steps, letter), "")), "UTF-8"))


SIGNATURE = "[Â-ô][\u0080-¿]"
#: Windows-1252 letters that are not Latin-1, and the Latin-1 controls with the same byte.
WINDOWS = "".join(c for b in range(128, 160) if len(c := bytes([b]).decode("cp1252", "ignore")))
CONTROLS = "".join(chr(b) for b in range(128, 160) if bytes([b]).decode("cp1252", "ignore"))


def repair_mojibake(text: Column, rounds: int = 3) -> Column:
    """UTF-8 that was read as Latin-1 or Windows-1252, put right as often as it happened, up to ``rounds`` times. A step counts only if the
    bytes are UTF-8 and fewer letters look misread after it; all else stays as it is."""
    def misread(x: Column) -> Column:
        return F.size(F.regexp_extract_all(x, F.lit(SIGNATURE), F.lit(0)))

    def reread(x: Column) -> Column:
        raw = F.encode(x, "ISO-8859-1")
        return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8"))

    def step(x: Column, _: Column) -> Column:
        latin = F.when(~x.rlike("[^\u0001-ÿ]"), reread(x))
        windows = F.when(~x.rlike(f"[^\u0001-\u007f -ÿ{WINDOWS}]"), reread(F.translate(x, WINDOWS, CONTROLS)))
        better = lambda y: F.when(misread(y) < misread(x), y)
        return F.when(x.rlike(SIGNATURE), F.coalesce(better(latin), better(windows), x)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.coalesce(text, F.lit("")), step)


# ---- accents


@lru_cache
def decomposed() -> tuple[str, str, str, dict[str, str]]:
    """(letters, the letters they become, combining marks, letters that become several): compatibility decomposition without marks. Hangul
    syllables stay whole."""
    one, to, marks, several = [], [], [], {}
    for n in range(128, sys.maxunicode + 1):
        c = chr(n)
        if 0xAC00 <= n <= 0xD7A3 or 0xD800 <= n <= 0xDFFF:
            continue
        if unicodedata.combining(c):
            marks.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c:
            continue
        if len(plain) == 1:
            one.append(c)
            to.append(plain)
        else:
            several[c] = plain
    return "".join(one), "".join(to), "".join(marks), several


def table_of(entries: dict[str, str]) -> Column:
    """A constant map; one literal, however many entries."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def runs(numbers, gap: int = 1) -> list[tuple[int, int]]:
    """Consecutive numbers, or such that are at most ``gap`` apart, as (first, last)."""
    out: list[list[int]] = []
    for n in sorted(numbers):
        if out and n <= out[-1][1] + gap:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [(a, b) for a, b in out]


def folded(text: Column) -> Column:
    """Letters without accents, ligatures and other forms as what they stand for."""
    one, to, marks, several = decomposed()
    keys = list(several)
    table = table_of(several)
    group = lambda found: "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in found) + "]"
    # engines try the ranges of a class one by one: a few wide ones first
    some = f"[{group(runs(map(ord, keys), 256))}&&{group(runs(map(ord, keys)))}]"

    def spelled(at: Column) -> Column:
        """Each letter that occurs, looked up once and replaced at all its places; no letter's spelling has another of them."""
        found = F.array_distinct(F.regexp_extract_all(at, F.lit(some), F.lit(0)))
        return F.aggregate(found, at, lambda x, c: F.replace(x, c, F.element_at(table, c)))

    return F.get(F.transform(F.array(F.translate(text, one + marks, to)), spelled), F.lit(0))


# ---- references

REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"


def character(n: Column) -> Column:
    """The letter of a code point; the replacement character where there is none."""
    byte = lambda first, shift: F.lpad(F.hex(F.lit(first) + F.shiftright(n, shift) % 64), 2, "0")
    head = lambda first, shift: F.hex(F.lit(first) + F.shiftright(n, shift))
    digits = (
        F.when(n < 0x80, F.lpad(F.hex(n), 2, "0")).when(n < 0x800, F.concat(head(0xC0, 6), byte(0x80, 0))).when(n < 0x10000, F.concat(head(0xE0, 12), byte(0x80, 6), byte(0x80, 0)))
        .otherwise(F.concat(head(0xF0, 18), byte(0x80, 12), byte(0x80, 6), byte(0x80, 0)))
    )
    none = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.when(none, "�").otherwise(F.decode(F.unhex(F.when(none, "3F").otherwise(digits)), "UTF-8"))


def unescaped(text: Column) -> Column:
    """Character references as what they stand for: numbers, all names of the standard, and old names without a semicolon."""
    names = html.entities.html5
    full = {k[:-1]: v for k, v in names.items() if k.endswith(";")}
    old = sorted((k for k in names if not k.endswith(";")), key=lambda k: (-len(k), k))
    table = table_of(full)
    windows = F.map_from_arrays(F.array(*[F.lit(ord(c)) for c in CONTROLS]), F.array(*map(F.lit, WINDOWS)))

    def stands_for(r: Column) -> Column:
        digits = F.regexp_extract(r, "^&#[xX]?([0-9a-fA-F]+)", 1)
        size = F.length(F.ltrim(digits, F.lit("0")))
        hexadecimal = F.when(size <= 7, F.conv(digits, 16, 10).try_cast("int"))
        n = F.when(r.rlike("^&#[xX]"), hexadecimal).otherwise(F.when(size <= 8, digits.try_cast("int")))
        number = F.when(n.between(1, 8) | n.between(14, 31) | (n == 11), "").otherwise(F.coalesce(F.try_element_at(windows, n), character(n)))
        name, prefix = F.regexp_extract(r, "^&([A-Za-z0-9]+);", 1), F.regexp_extract(r, "^&(" + "|".join(old) + ")", 1)
        known = F.when(name != "", F.try_element_at(table, name))
        loose = F.when(prefix != "", F.concat(F.try_element_at(table, prefix), F.substring(r, F.length(prefix) + 2, F.length(r))))
        return F.when(r.rlike("^&#"), number).otherwise(F.coalesce(known, loose, r))

    pieces, refs = F.split(text, REFERENCE), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    joined = F.array_join(F.zip_with(pieces, refs, lambda p, r: F.concat(p, F.when(r.isNotNull(), stands_for(r)).otherwise(""))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)
