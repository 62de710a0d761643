"""Column expressions for raw log fields: null for missing or bad text, with the checks that tell the two apart."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANK = " \t\n\r\x0b\x0c"
#: Texts that stand for a missing value.
FLOW_MISSING = ["", "-", "(empty)", "-1"]
ZEEK_MISSING = ["", "-", "(empty)"]

_INT = r"^\s*[+-]?\d{1,18}\s*$"
_FLOAT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANK))


def clean(c: Column, missing: list[str], stripped: bool = True) -> Column:
    c = strip(c) if stripped else c
    return F.when(~c.isin(missing), c)


def to_int(c: Column) -> Column:
    return F.when(c.rlike(_INT), F.trim(c).try_cast("long"))


def to_port(c: Column) -> Column:
    """Decimal, or hexadecimal after 0x."""
    low = F.lower(c)
    return F.when(low.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(low, 3, 8), 16, 10).cast("long")).otherwise(to_int(c))


def to_float(c: Column) -> Column:
    return F.when(c.rlike(_FLOAT), F.trim(c).try_cast("double"))


_HEX = "[0-9A-Fa-f]{1,4}"
_TAIL = rf"^(.*:){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"


def made_with(c: Column, made) -> Column:
    """``made`` of ``c``, which is made once."""
    return F.transform(F.array(c), made)[0]


def _shortened(groups: Column) -> Column:
    """Eight groups as text: the first of the longest runs of two zeros or more is left out; a mapped IPv4 address is written with dots."""
    marked = [F.when(groups.rlike(zeros), F.regexp_replace(groups, zeros, "$1z$2")) for zeros in (rf"^(|.*?:)0(?::0){{{k - 1}}}(|:.*)$" for k in range(8, 1, -1))]
    octets = [x for g in (6, 7) for n in [F.conv(F.split(groups, ":")[g], 16, 10).cast("int")] for x in (F.shiftright(n, 8), n.bitwiseAND(255))]
    mapped = F.concat(F.lit("::ffff:"), F.concat_ws(".", *[x.cast("string") for x in octets]))
    return F.when(groups.startswith("0:0:0:0:0:ffff:"), mapped).otherwise(F.regexp_replace(F.coalesce(*marked, groups), "(?:^|:)z(?:$|:)", "::"))


def _ipv6(c: Column) -> Column:
    """Canonical text of an IPv6 address as the standard library's ``ipaddress`` writes it, null for any other text; stays in the JVM, so that no row waits for Python."""

    def parsed(address: Column) -> Column:
        """Eight groups in lower case without leading zeros."""
        sides = F.split(address, "::")
        of = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
        high, low = of(sides[0]), of(F.coalesce(F.get(sides, 1), F.lit("")))
        groups = F.concat(high, F.array_repeat(F.lit("0"), 8 - F.size(high) - F.size(low)), low)
        whole, cut = rf"{_HEX}(:{_HEX}){{7}}", rf"({_HEX}(:{_HEX})*)?::({_HEX}(:{_HEX})*)?"
        good = address.rlike(rf"^({whole}|{cut})\z") & (~address.contains("::") | (F.size(high) + F.size(low) < 8))
        return F.when(good, F.array_join(F.transform(groups, lambda g: F.lower(F.regexp_replace(g, "^0+(?=.)", ""))), ":"))

    hex_of = lambda t, i: F.lower(F.hex(F.regexp_extract(t, _TAIL, i).cast("long") * 256 + F.regexp_extract(t, _TAIL, i + 1).cast("long")))
    dotted = lambda t: F.when(t.rlike(_TAIL), F.concat(F.regexp_extract(t, _TAIL, 1), hex_of(t, 2), F.lit(":"), hex_of(t, 4))).otherwise(t)
    address = F.regexp_extract(c, "^[^%]*", 0)
    return F.when(c.rlike(r"^[0-9A-Fa-f:.]+(%[^%/]+)?\z"), F.concat(made_with(made_with(made_with(address, dotted), parsed), _shortened), F.regexp_extract(c, r"%[^%/]+\z", 0)))


def to_ip(c: Column) -> Column:
    """Canonical address text."""
    return F.when(c.rlike(_IPV4), c).when(c.contains(":"), made_with(c, _ipv6))


def to_utc(c: Column, zone: str) -> Column:
    """A local time of ``zone``, or one with its own offset, as an instant (sessions run in UTC)."""
    text = F.replace(c, F.lit("/"), F.lit("-"))
    offset = text.rlike(r"\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})$")
    local = text.try_cast("timestamp_ntz")
    return F.when(offset, text.try_cast("timestamp")).otherwise(F.convert_timezone(F.lit(zone), F.lit("UTC"), local).cast("timestamp"))


def from_epoch(c: Column) -> Column:
    return F.timestamp_micros(F.round(c * 1_000_000).cast("long"))


def flow_label(label: Column) -> Column:
    """Coarse label of ``flow=...`` texts."""
    body = F.lower(strip(F.regexp_replace(label, r"(?i)^flow=", "")))
    return F.when((body == "normal") | body.startswith("from-normal"), "benign").when((body == "botnet") | body.startswith("from-botnet"), "malicious").otherwise("unknown")


def zeek_label(label: Column, detailed: Column) -> Column:
    found = F.lower(F.coalesce(detailed, label))
    return F.when(found.isNull(), "unknown").when(found == "benign", "benign").otherwise("malicious")


def total(a: Column, b: Column) -> Column:
    """Null only where both sides are."""
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
