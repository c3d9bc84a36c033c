"""Column functions over paths, flags and times of entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def name(path: Column) -> Column:
    """The last component."""
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the name, in lower case; empty without a dot or where only the first
    character is one."""
    return F.lower(F.regexp_extract(name(path), r"^.+\.([^.]*)$", 1))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def ancestors(path: Column) -> Column:
    """All proper prefixes of whole components, the shortest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    )


def parent(path: Column) -> Column:
    """The path above, null at the top."""
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def contains_ascii(path: Column, text: str) -> Column:
    """Whether the path holds the text, A-Z and a-z being alike and no other letters; empty text is everywhere."""
    return ascii_lower(path).contains(text.translate(str.maketrans(UPPER, LOWER)))


def iso_time(ns: Column) -> Column:
    """Nanoseconds since 1970 as ISO 8601 to the second, rounded down; null stays null."""
    # pmod keeps the division in whole numbers, so negative times round down too.
    seconds = (ns - F.pmod(ns, F.lit(1_000_000_000))) / F.lit(1_000_000_000)
    return F.date_format(F.timestamp_seconds(seconds.cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


FLAGS = [(1, "x", "executable"), (2, "h", "hidden"), (4, "r", "read_only"), (8, "s", "system")]


def flag_letters(flags: Column) -> Column:
    return F.concat(*[F.when(flags.bitwiseAND(bit) > 0, letter).otherwise("-") for bit, letter, _ in FLAGS])


def flag_names(flags: Column) -> Column:
    return F.array_compact(F.array(*[F.when(flags.bitwiseAND(bit) > 0, word) for bit, _, word in FLAGS]))


def escaped(text: Column) -> Column:
    """Backslash, tab, line feed and return written out as in C; other controls as \\xHH."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for sign, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(sign), F.lit(shown))
    for code in [*range(0, 9), 11, 12, *range(14, 32), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return F.when(text.rlike(r"[\x00-\x1f\x7f\\]"), out).otherwise(text)


#: Why a path can't be in the table: the first rule that it breaks.
def path_fault(path: Column) -> Column:
    parts = F.split(path, "/")
    any_part = lambda test: F.exists(parts, test)
    return (
        F.when(path == "", "empty")
        .when(F.octet_length(path) > 65535, "too long")
        .when(path.startswith("/"), "absolute")
        .when(path.contains("\\"), "backslash")
        .when(path.contains("\x00"), "nul")
        .when(any_part(lambda p: p == ""), "empty component")
        .when(any_part(lambda p: (p == ".") | (p == "..")), "dot component")
    )


#: Names that Windows keeps for devices, in capitals; spaces and what follows a dot don't count.
DEVICES = r"^(CON|PRN|AUX|NUL|CONIN\$|CONOUT\$|(COM|LPT)[1-9\u00b9\u00b2\u00b3])\x20*(\..*)?$"
#: UTF-16 units of a name and of a whole path.
NAME_UNITS, PATH_UNITS = 255, 32_767


def is_device(part: Column) -> Column:
    return F.upper(part).rlike(f"(?s){DEVICES}")


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def first_fault(parts: Column, fault) -> Column:
    """The fault of the first part that has one."""
    return F.get(F.array_compact(F.transform(parts, fault)), F.lit(0))


def unsafe(path: Column, folder_units: int = 0) -> Column:
    """Why a path isn't safe to extract below a folder whose own name has ``folder_units``: the first reason, else null."""

    def fault(p: Column) -> Column:
        return (
            F.when((p == ".") | (p == ".."), "dot component")
            .when(p.contains(":"), "colon")
            .when(p.endswith(".") | p.endswith(" "), "trailing dot or space")
            .when(is_device(p), "reserved device name")
        )

    parts = F.split(path, "/")
    total = F.lit(folder_units) + units(path) + 1
    return (
        F.when(path.startswith("/"), "leading slash")
        .when(path.contains("\\"), "backslash")
        .otherwise(
            F.coalesce(
                first_fault(parts, fault),
                F.when(F.exists(parts, lambda p: units(p) > NAME_UNITS), "name too long").when(total > PATH_UNITS, "path too long"),
            )
        )
    )


def link_target(link: Column, target: Column) -> tuple[Column, Column]:
    """Where a link leads within the tree, and why it isn't followed; one of them is null.

    Nothing is looked up: a target may climb first, no higher than the tree, and then only descend.
    """
    parts = F.filter(F.split(target, "/"), lambda p: ~p.isin("", "."))
    first = F.array_position(F.transform(parts, lambda p: p != ".."), F.lit(True)).cast("int")
    ups = F.when(first == 0, F.size(parts)).otherwise(first - 1)
    names = F.slice(parts, ups + 1, F.greatest(F.size(parts), F.lit(1)))
    above = F.size(F.split(link, "/")) - 1

    def fault(p: Column) -> Column:
        return (
            F.when(p == "..", "climbs after a name")
            .when(p.contains(":"), "colon")
            .when(p.endswith(".") | p.endswith(" "), "trailing dot or space")
            .when(is_device(p), "reserved device name")
        )

    why = (
        F.when(F.coalesce(target, F.lit("")) == "", "empty")
        .when(target.contains("\x00"), "nul")
        .when(target.rlike(r"^[/\\]([/\\][?.]|\?\?)[/\\]"), "device path")
        .when(target.rlike(r"^[/\\]{2}"), "network path")
        .when(target.rlike(r"^[/\\]"), "rooted")
        .when(target.rlike(r"^[A-Za-z]:[/\\]"), "absolute")
        .when(target.rlike(r"^[A-Za-z]:"), "drive-relative")
        .when(target.contains("\\"), "backslash")
        .otherwise(F.coalesce(first_fault(names, fault), F.when(ups > above, "leaves the tree")))
    )
    to = F.array_join(F.concat(F.slice(F.split(link, "/"), F.lit(1), F.greatest(above - ups, F.lit(0))), names), "/")
    return F.when(why.isNull(), to), why


def natural_key(text: Column) -> Column:
    """A key whose order takes runs of digits as numbers of any length, and the rest by bytes; ties go by the text.

    A number is written as its length and its digits without zeros before them, so that longer ones come later;
    other runs end with a sign below all others, so that the shorter of two comes first.
    """
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    one = lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(bare(p)).cast("string"), 10, "0"), bare(p))).otherwise(F.concat(p, F.lit("\x00")))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)")), one), "")
