"""Scalar functions as column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.schemas import BYTE_UNITS, ERRNO, HEADER_BYTES, MODE_DIR, MODE_REGULAR, MODE_SYMLINK, TRAILER_BYTES, TYPE_MASK


def _type_is(mode: Column, kind: int) -> Column:
    return mode.bitwiseAND(F.lit(TYPE_MASK)) == kind


def is_dir(mode: Column) -> Column:
    return _type_is(mode, MODE_DIR)


def is_regular(mode: Column) -> Column:
    return _type_is(mode, MODE_REGULAR)


def is_symlink(mode: Column) -> Column:
    return _type_is(mode, MODE_SYMLINK)


def valid_name(name: Column) -> Column:
    """Neither empty nor `.` or `..`, without a slash or a NUL; a null name isn't valid."""
    return F.coalesce(~name.isin("", ".", "..") & ~name.contains("/") & ~name.contains("\0"), F.lit(False))


def split_path(path: Column) -> Column:
    """Components after lexical normalisation: empty and `.` vanish, `..` takes back one; the root has none."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    # slice() wants a length of at least 0, and `..` at the root stays there
    return F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))


def tier_name(tier: Column) -> Column:
    return F.when(tier == 1, "hot").when(tier == 2, "cold").when(tier == 3, "mem").otherwise(F.concat(F.lit("tier("), tier.cast("string"), F.lit(")")))


def framed_size(payload_length: Column) -> Column:
    return payload_length + (HEADER_BYTES + TRAILER_BYTES)


def errno(status: Column) -> Column:
    """Error name -> number: null is success, a name without a number is EIO."""
    known = F.create_map(*(x for k, v in ERRNO.items() for x in (F.lit(k), F.lit(v))))
    return F.when(status.isNull(), 0).otherwise(F.coalesce(known[status], F.lit(ERRNO["EIO"])))


def parse_bytes(text: Column) -> Column:
    """`10GiB`, `1.5g`, `1024` -> bytes; every unit counts by 1024. Null where the text isn't a size of 0 or more."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    suffix = F.lower(F.regexp_extract(whole, r"([A-Za-z]*)$", 1))
    number = F.regexp_replace(F.regexp_replace(whole, r"[A-Za-z]*$", ""), r"^\s+|\s+$", "")
    unit = F.regexp_replace(F.regexp_replace(suffix, r"^([kmgtp])i?b$", "$1"), "^b$", "")
    powers = F.create_map(*(x for k, v in BYTE_UNITS.items() if k != "b" for x in (F.lit(k), F.lit(1 << v))))
    factor = powers[unit]
    integer = F.when(number.rlike(r"^[+-]?[0-9]+$"), number.try_cast("long"))
    # Hexadecimal, infinite and not-a-number forms aren't sizes.
    real = F.when(number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), number.try_cast("double"))
    product = F.when(integer.isNotNull(), F.try_multiply(integer, factor)).otherwise((real * factor).try_cast("long"))
    return F.when((number != "") & (F.coalesce(integer.cast("double"), real) >= 0), product)


def format_bytes(n: Column) -> Column:
    """The largest unit that divides n exactly, else the plain number."""
    out = F.when(n == 0, "0")
    for unit, power in (("PiB", 50), ("TiB", 40), ("GiB", 30), ("MiB", 20), ("KiB", 10)):
        size = F.lit(1 << power)
        out = out.when(n % size == 0, F.concat(F.shiftright(n, power).cast("string"), F.lit(unit)))
    return out.otherwise(n.cast("string"))


def endpoint(raw: Column, insecure_override: Column) -> Column:
    """host and whether to go without TLS; null host for a scheme other than http and https."""
    bare = ~raw.contains("://")
    scheme = F.lower(F.substring_index(raw, "://", 1))
    host = F.regexp_extract(raw, r"://(?:[^/?#@]*@)?([^/?#]*)", 1)
    known = scheme.isin("http", "https")
    insecure = F.when(bare, True).when(scheme == "http", True).when(scheme == "https", insecure_override)
    return F.struct(F.when(bare, raw).when(known, host).alias("host"), insecure.alias("insecure"))


def segment_file(segment_id: Column) -> Column:
    return F.format_string("%010d.seg", segment_id)


def segment_id_of(file: Column) -> Column:
    """The id in the name of a segment file; null for other files and for numbers beyond 32 bits."""
    n = F.regexp_extract(file, r"(?:^|/)([0-9]+)\.seg$", 1).try_cast("long")
    return F.when(n.between(0, (1 << 32) - 1), n)


def log_level(text: Column) -> Column:
    """debug, info, warn or error in any case (`warning` is warn); null for others."""
    low = F.lower(text)
    return F.when(low == "warning", "warn").when(low.isin("debug", "info", "warn", "error"), low)


def log_format(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low == "", "text").when(low.isin("text", "json"), low)


def prefix_upper_bound(prefix: bytes) -> bytes | None:
    """The least key above all that start with prefix; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def in_range(key: Column, low: bytes | None, high: bytes | None) -> Column:
    """low <= key < high in byte order; None is open."""
    above = F.lit(True) if low is None else key >= F.lit(bytearray(low))
    return above if high is None else above & (key < F.lit(bytearray(high)))


def number(value: Column, science: int = 6) -> Column:
    """A double as `%g` prints it without a precision: the fewest digits that tell it apart, with an exponent of at least
    two digits below 1e-4 and from 1e6 (hence 1e+06), or from another power of ten, `science`."""
    text = F.abs(value).cast("string")
    mantissa, power = F.substring_index(text, "E", 1), F.regexp_extract(text, r"E(-?[0-9]+)", 1).try_cast("int")
    whole, fraction = F.substring_index(mantissa, ".", 1), F.regexp_extract(mantissa, r"[.]([0-9]*)", 1)
    digits = F.regexp_replace(F.concat(whole, fraction), "^0+|0+$", "")
    leading = F.length(fraction) - F.length(F.regexp_replace(fraction, "^0+", ""))
    exponent = F.when(power.isNotNull(), power).when(whole != "0", F.length(whole) - 1).otherwise(-leading - 1)
    tail = F.substring(digits, 2, 400)
    scientific = F.concat(F.substring(digits, 1, 1), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    split = F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.lit(400)))
    plain = F.when(exponent < 0, small).when(F.length(digits) > exponent + 1, split).otherwise(F.rpad(digits, exponent + 1, "0"))
    shown = F.when((exponent < -4) | (exponent >= science), scientific).otherwise(plain)
    special = F.when(F.isnan(value), "NaN").when(value == float("inf"), "+Inf").when(value == float("-inf"), "-Inf").when(value == 0, "0")
    return F.coalesce(special, F.concat(F.when(value < 0, "-").otherwise(""), shown))


def same_bytes(a: Column, b: Column) -> Column:
    """Whether two byte slices are equal; two nulls are, like two empty slices."""
    empty = F.lit(bytearray())
    return F.coalesce(a.cast("binary"), empty) == F.coalesce(b.cast("binary"), empty)
