"""Scalar text functions as column expressions; offsets are code points, half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a regular expression that Java and RE2 read alike.
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Line breaks, or the place after a mark that ends a sentence.
BREAKS = r"[\r\n]+|(?<=[。！？!?；;])"
HAN = r"[\x{3400}-\x{9fff}]"


def strip(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def pieces(text: Column) -> Column:
    """Normalised sentences of a text, empty ones included."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), BREAKS), strip)


def join_fields(*fields: Column) -> Column:
    """Fields that aren't blank, joined by a full stop."""
    filled = [F.when(strip(f) != "", F.regexp_replace(f, f"^{SPACES}|{SPACES}$", "")) for f in fields]
    return F.concat_ws("。", *filled)


def stable_id(value: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(value, 256), 1, length)


def salted_id(prefix: str, value: Column, length: int = 20) -> Column:
    return stable_id(F.concat(F.lit(prefix + "\0"), value), length)


def slice_of(text: Column, start: Column, end: Column) -> Column:
    """text[start:end]."""
    return F.substring(text, start + 1, end - start)


def char_at(text: Column, i: Column) -> Column:
    """The character at an index, or a mark for a place before the start or after the end."""
    n = F.length(text)
    return F.when(i < 0, F.concat(F.lit("<BOS"), (-i).cast("string"), F.lit(">"))).when(i >= n, F.concat(F.lit("<EOS"), (i - n + 1).cast("string"), F.lit(">"))).otherwise(F.substring(text, i + 1, F.lit(1)))


def char_class(c: Column) -> Column:
    """Class of a character; marks (and any `<`) are classes themselves."""
    cp = F.ascii(c)
    return (
        F.when(c.startswith("<"), c)
        .when(cp.between(0x3400, 0x9FFF) | cp.between(0x20000, 0x2EBEF), "HAN")
        .when(cp.between(0x30, 0x39) | cp.between(0xFF10, 0xFF19), "DIGIT")
        .when(cp.between(0x41, 0x5A) | cp.between(0x61, 0x7A), "LATIN")
        .when(c.rlike(f"^{SPACES}$"), "SPACE")
        .when((cp < 0x80) | cp.isin(0xA1, 0xA7, 0xAB, 0xB6, 0xB7, 0xBB, 0xBF) | cp.between(0x2010, 0x2027) | cp.between(0x3001, 0x3003) | cp.between(0x3008, 0x3011) | cp.between(0xFF01, 0xFF0F), "PUNCT")
        .otherwise("OTHER")
    )


#: Characters that a name may hold (see `is_body`), and marks between two of them.
BODY = r"[0-9\x{ff10}-\x{ff19}A-Za-z\x{c0}-\x{24f}\x{370}-\x{52f}\x{3400}-\x{9fff}\x{20000}-\x{2ebef}]"
CONNECTOR = r"[\x{b7}\-\x{2010}\x{2011}&/]"


def is_digit(cp: Column) -> Column:
    return cp.between(0x30, 0x39) | cp.between(0xFF10, 0xFF19)


def is_letter(cp: Column) -> Column:
    """Letters by explicit ranges, so that every engine agrees."""
    return cp.between(0x41, 0x5A) | cp.between(0x61, 0x7A) | cp.between(0xC0, 0x24F) | cp.between(0x370, 0x52F)


def is_body(cp: Column) -> Column:
    """Characters that a name may hold."""
    return is_digit(cp) | is_letter(cp) | cp.between(0x3400, 0x9FFF) | cp.between(0x20000, 0x2EBEF)


def is_connector(cp: Column) -> Column:
    """Marks that may stand between two body characters of a name."""
    return cp.isin(0xB7, 0x2D, 0x2010, 0x2011, 0x26, 0x2F)


def ascii_cut(text: Column, start: Column, end: Column) -> Column:
    """Whether a span cuts a run of ASCII letters and digits at either side."""
    both = lambda at: F.substring(text, at, F.lit(2)).rlike("^[0-9A-Za-z]{2}$")
    return ((start > 0) & both(start)) | ((end < F.length(text)) & both(end))


def length_bucket(n: Column) -> Column:
    return F.when(n >= 5, "5+").otherwise(n.cast("string"))


def entity_tags(kind: Column | None, n: Column) -> Column:
    """Tags of an entity of n characters; none if there are none."""
    tag = (lambda p: F.lit(p)) if kind is None else (lambda p: F.concat(F.lit(p + "_"), kind))
    return F.when(n < 1, F.array().cast("array<string>")).when(n == 1, F.array(tag("S"))).otherwise(F.concat(F.array(tag("B")), F.array_repeat(tag("M"), (n - 2).cast("int")), F.array(tag("E"))))


def fnv1a64(value: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as DECIMAL(20, 0): the product is taken modulo 2**64 in halves."""
    size = F.lit("18446744073709551616").cast("decimal(38,0)")
    h0 = F.lit("14695981039346656037").cast("decimal(38,0)")
    bytes_of = F.transform(F.sequence(F.lit(1), F.octet_length(value)), lambda i: F.conv(F.substring(F.hex(F.encode(value, "UTF-8")), (i * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("int"))

    def step(h, b):
        low = F.pmod(h, F.lit(256).cast("decimal(38,0)")).cast("int")
        x = h - low + low.bitwiseXOR(b)
        # 1099511628211 = 2**40 + 435; both products stay below 10**38.
        return F.pmod(F.pmod(x * F.lit(435), size) + F.pmod(x, F.lit(16777216).cast("decimal(38,0)")) * F.lit(1099511627776), size).cast("decimal(38,0)")

    return F.when(value == "", h0).otherwise(F.aggregate(bytes_of, h0, step)).cast("decimal(20,0)")


def runs(text: Column, pattern: str) -> Column:
    """array<struct<start, end>> of what a pattern without groups finds in a text, from left to right."""
    # Cut at the pattern, and what it found between the cuts: their lengths give the places.
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.length(f))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def put(done, x):
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)) + x["gap"]
        return F.concat(done, F.array(F.struct(start.cast("int").alias("start"), (start + x["n"]).cast("int").alias("end"))))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, n: F.struct(g.alias("gap"), n.alias("n")))
    return F.when(F.size(found) == 0, none).otherwise(F.aggregate(pairs, none, put))
