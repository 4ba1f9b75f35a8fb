"""Text functions that agree with Python's ``str`` methods, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points for which str.isspace() is true.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: The same as ranges, which the JVM's matcher tells faster than single code points.
_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_RUN = f"[{_SPACE}]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """The runs between white space, as ``str.split()``."""
    return F.filter(F.split(text, _SPACE_RUN, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    """``len(str.split())``: runs of what isn't white space are counted, without an array of them."""
    return F.regexp_count(text, F.lit(f"[^{_SPACE}]++"))


#: Set before every run of cased letters while a text is title-cased; a noncharacter, which texts don't hold.
_MARK = "\ufdd0 "
_CASED = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"


def title(text: Column) -> Column:
    """``str.title()``: in every run of cased letters the first is upper and the rest lower case. ``initcap`` does that
    after spaces, so every run gets one for a moment."""
    marked = F.regexp_replace(F.lower(text), f"(?<!{_CASED})(?={_CASED})", _MARK)
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def number(text: Column) -> Column:
    """What int() makes of a text, or float() if it holds a dot; 0 where that fails. Always a double here."""
    bare = strip(text)
    plain = F.replace(bare, F.lit("_"), F.lit(""))
    whole = bare.rlike(r"^[+-]?\d+(_\d+)*$")
    point = bare.rlike(r"^[+-]?(\d+(_\d+)*)?\.(\d+(_\d+)*)?([eE][+-]?\d+(_\d+)*)?$") & bare.rlike(r"^[^eE]*\d")
    return F.when(F.when(F.contains(bare, F.lit(".")), point).otherwise(whole), plain.try_cast("double")).otherwise(F.lit(0.0))


def present(text: Column) -> Column:
    """The text, or null where it is empty: what Python's ``or`` passes over."""
    return F.nullif(text, F.lit(""))
