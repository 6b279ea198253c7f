"""Scalar functions of paths, versions, positions, dates, maps and keys, as column expressions within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that take two cells of a terminal, and those that take none.
WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}\x{1F900}-\x{1F9FF}\x{20000}-\x{3FFFD}]"
NARROW = r"[\x{0300}-\x{036F}\x{200B}-\x{200F}\x{FE00}-\x{FE0F}\x{20D0}-\x{20FF}]"


def counted(text: Column, pattern: str) -> Column:
    """How many characters of a one-character pattern a text holds."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 code units: characters beyond the basic plane count twice."""
    return F.length(text) + counted(text, r"[\x{10000}-\x{10FFFF}]")


def cell_width(text: Column) -> Column:
    """Cells that a line takes on a terminal."""
    return F.length(text) + counted(text, WIDE) - counted(text, NARROW)


def at_boundary(data: Column, offset: Column) -> Column:
    """Whether a byte offset of UTF-8 data (binary) stands between characters; false outside of the data."""
    size = F.octet_length(data)
    byte = F.conv(F.hex(F.substring(data, (offset + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (offset >= 0) & (offset <= size) & ((offset == size) | (byte.bitwiseAND(F.lit(0xC0)) != 0x80))


def byte_slice(data: Column, start: Column, end: Column) -> Column:
    """The bytes from start to end as text; null unless both stand between characters and in order."""
    inside = at_boundary(data, start) & at_boundary(data, end) & (start <= end)
    return F.when(inside, F.decode(F.substring(data, (start + 1).cast("int"), (end - start).cast("int")), "UTF-8"))


def lines_with_ends(text: Column) -> Column:
    """Lines with their newlines, no empty one behind the last."""
    return F.filter(F.split(text, r"(?<=\n)"), lambda x: x != "")


def portable(path: Column) -> Column:
    """Whether a path is relative and means the same everywhere: slashes, no drive, no empty, ``.`` or ``..`` segment."""
    bad = F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    return ~(bad | path.contains("\\") | path.rlike("^[A-Za-z]:") | path.rlike(r"[\x00-\x1F]"))


def inside(path: Column, root: Column) -> Column:
    """Whether a path is the root or below it, by whole segments."""
    return (path == root) | path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def cleaned(path: Column) -> Column:
    """The path without empty and ``.`` segments and with ``..`` taken back; a rooted path never climbs above its root."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    empty = F.array().cast("array<string>")

    def step(done: Column, s: Column) -> Column:
        climbs = F.size(done) == 0
        last = F.element_at(done, F.greatest(F.size(done), F.lit(1)))
        kept = F.when(~climbs & (F.try_element_at(done, F.greatest(F.size(done), F.lit(1))) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        del last
        return F.when(s != "..", F.array_append(done, s)).otherwise(F.coalesce(kept, F.when(rooted, done).otherwise(F.array_append(done, s))))

    out = F.array_join(F.aggregate(parts, empty, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), out)).when(out == "", ".").otherwise(out)


def file_uri(path: Column) -> Column:
    """A file URI: every segment escaped, slashes kept."""
    return F.concat(F.lit("file://"), F.array_join(F.transform(F.split(path, "/"), lambda s: F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))), "/"))


def version(text: Column) -> Column:
    """The numbers of a version such as go1.21.3, three of them; null for other texts."""
    own = F.regexp_extract(text, r"^(?:go|v)?(\d+(?:\.\d+){0,2})$", 1)
    numbers = F.transform(F.split(own, r"\."), lambda x: x.cast("int"))
    return F.when(own != "", F.slice(F.concat(numbers, F.array(F.lit(0), F.lit(0))), 1, 3))


def not_newer(a: Column, b: Column) -> Column:
    return version(a) <= version(b)


def strict_date(text: Column) -> Column:
    """The date of a text that is exactly YYYY-MM-DD; null otherwise."""
    own = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.date_format(own, "yyyy-MM-dd") == text, own)


def expired(text: Column, cutoff: Column) -> Column:
    return F.coalesce(strict_date(text) <= cutoff, F.lit(False))


def later_wins(first: Column, second: Column) -> Column:
    """Two maps as one; of a key in both the second's value."""
    return F.map_zip_with(first, second, lambda k, a, b: F.coalesce(b, a))


def in_bounds(value: Column, least: int, most: int, name: str) -> Column:
    """The value of an option, which has to lie within bounds: an error otherwise."""
    message = F.concat(F.lit(f"{name} lies outside of {least} to {most}: "), value.cast("string"))
    return F.when((value >= least) & (value <= most), value).otherwise(F.raise_error(message).cast("long"))


def added(a: Column, b: Column) -> Column:
    """The sum of two longs; null where it doesn't fit, which callers tell as an error."""
    return F.try_add(a.cast("long"), b.cast("long"))


def keyed(*parts: Column) -> Column:
    """A digest of parts that can't run into each other: each has its length in front, eight bytes."""
    prefixed = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0")), p.cast("binary")) for p in parts]
    return F.sha2(F.concat(*prefixed), 256)


def plain_url(url: Column) -> Column:
    """A repository's address for comparison: no user, scheme, default suffix or slash at the end; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"^[^@/]*@", "")
    bare = F.regexp_replace(bare, r"(\.git)?/*$", "")
    host = F.regexp_extract(bare, r"^([^/]*)", 1)
    return F.concat(F.lower(host), F.substring(bare, F.length(host) + 1, F.length(bare)))


def escaped(text: Column) -> Column:
    """A text for a terminal: control characters as codes, so that none acts on it."""
    out = F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "\\\\x?")
