"""Scalar functions as Catalyst expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions import fixed


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches(c: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    """Search with Unicode classes, as the catalogue means its patterns."""
    return col(c).rlike(("(?iuU)" if ignore_case else "(?U)") + pattern)


def first_group(c: Column | str, pattern: str, group: int) -> Column:
    return F.regexp_extract(col(c), "(?U)" + pattern, group)


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def excerpt(c: Column | str, n: int = 300) -> Column:
    return F.substring(strip(c), 1, n)


def sanitize(c: Column | str) -> Column:
    """Without terminal escapes, then without control characters other than tab and newline."""
    return F.regexp_replace(F.regexp_replace(col(c), fixed.ESCAPES, ""), fixed.CONTROLS, "")


def escape_markdown(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(sanitize(c), "\n", " "), r"([\\`*_{}\[\]<>()#+!|~])", r"\\$1")


def formula_guard(c: Column | str) -> Column:
    """A report cell that no spreadsheet runs as a formula."""
    text = F.regexp_replace(sanitize(F.coalesce(col(c).cast("string"), F.lit(""))), "\n", " ")
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)


def entropy(c: Column | str) -> Column:
    """Shannon entropy in bits a character; 0 of the empty text."""
    c = col(c)
    n = F.length(c)
    share = lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n
    total = F.aggregate(F.array_distinct(F.split(c, "")), F.lit(0.0), lambda a, x: F.when(x == "", a).otherwise(a - share(x) * F.log2(share(x))))
    return F.when(n > 0, total).otherwise(F.lit(0.0))


def alphabet_share(c: Column | str) -> Column:
    """Share of neighbours that follow each other in code order; 0 below two characters."""
    c = col(c)
    n = F.length(c)
    steps = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0), lambda a, i: a + F.when(F.ascii(F.substring(c, i + 1, F.lit(1))) == F.ascii(F.substring(c, i, F.lit(1))) + 1, 1).otherwise(0))
    return F.when(n >= 2, steps / (n - 1)).otherwise(F.lit(0.0))


def is_packed(blob: Column, least: float = fixed.ENTROPY_LEAST) -> Column:
    return (entropy(blob) >= least) & (alphabet_share(blob) <= fixed.ALPHABET_MOST)


def osa_distance(a: str, b: str) -> Column:
    """Optimal-string-alignment distance of two string columns: rows of the dynamic program in two nested folds."""
    return F.expr(f"""
      CASE WHEN length({a}) = 0 THEN length({b}) WHEN length({b}) = 0 THEN length({a}) ELSE
      element_at(aggregate(sequence(1, length({a})),
        named_struct('before', cast(array() AS array<int>), 'last', sequence(0, length({b}))),
        (rows, i) -> named_struct('before', rows.last, 'last',
          aggregate(sequence(1, length({b})), array(i), (row, j) -> array_append(row, least(
            rows.last[j] + 1, row[j - 1] + 1,
            rows.last[j - 1] + if(substring({a}, i, 1) = substring({b}, j, 1), 0, 1),
            if(i > 1 AND j > 1 AND substring({a}, i, 1) = substring({b}, j - 1, 1) AND substring({a}, i - 1, 1) = substring({b}, j, 1),
               rows.before[j - 2] + 1, 1000000)))))).last, -1) END""")


def unbroken_base64(c: Column) -> Column:
    """Base64 on one line, whatever the session does with long lines."""
    return F.regexp_replace(F.base64(c), r"[\r\n]", "")


def url_quote(c: Column) -> Column:
    """Percent-encoding of everything but letters, digits and -._~."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canary_forms(c: Column | str) -> Column:
    """The 11 forms a stolen value is looked for in: plain, base64, hex, percent, and inside a longer base64 text."""
    c = col(c)
    raw = F.encode(c, "UTF-8")
    b64 = unbroken_base64(raw)
    url = lambda x: F.translate(x, "+/", "-_")
    bare = lambda x: F.regexp_replace(x, "=+$", "")
    inner = []
    for shift, drop in ((1, 2), (2, 3)):
        moved = unbroken_base64(F.concat(F.unhex(F.lit("00" * shift)), raw))
        middle = F.substring(moved, F.lit(drop + 1), F.length(moved) - drop - 4)
        inner += [middle, url(middle)]
    return F.array(c, b64, bare(b64), url(b64), bare(url(b64)), F.lower(F.hex(raw)), url_quote(c), *inner)


def normalize_name(c: Column | str) -> Column:
    """A Python project name in its one spelling."""
    return F.lower(F.regexp_replace(col(c), "[-_.]+", "-"))


def is_exact(version: Column | str, ecosystem: Column | str) -> Column:
    v = col(version)
    return F.when(col(ecosystem) == "pypi", v.rlike("(?d)" + fixed.EXACT_PYPI)).otherwise(v.rlike("(?d)" + fixed.EXACT_NPM))


def dossier_key(ecosystem: Column | str, package: Column | str, version: Column | str) -> Column:
    return F.concat(col(ecosystem), F.lit(":"), col(package), F.lit("@"), col(version))


def signal_id(source: Column, category: Column, discriminator: Column) -> Column:
    return F.substring(F.sha1(F.encode(F.concat(source, F.lit(":"), category, F.lit(":"), discriminator), "UTF-8")), 1, 16)


def piece(shown: Column, file: Column | None = None, line: Column | None = None, detail: Column | None = None) -> Column:
    """One piece of evidence, in the one shape that all signals share."""
    none = F.lit(None)
    return F.struct(shown.cast("string").alias("excerpt"), (none if file is None else file).cast("string").alias("file"), (none if line is None else line).cast("int").alias("line"), (none if detail is None else detail).cast("string").alias("detail"))


def host_only(c: Column | str) -> Column:
    """Host without a port: what stands before the last colon, or the whole."""
    c = col(c)
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)^(.*):[^:]*$", 1), F.lit("")), c)


def short(c: Column | str, limit: int = 300) -> Column:
    text = sanitize(c)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("… (+"), (F.length(text) - limit).cast("string"), F.lit(" chars)")))


def severity_rank(c: Column | str) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, fixed.SEVERITIES)), col(c)) - 1, F.lit(-1)).cast("int")


def parse_spec(c: Column | str) -> Column:
    """Struct (ecosystem, name, version) of `pypi:name==1.0`, `npm:@a/b@1.0`; null where there is no version."""
    c = col(c)
    pypi = c.startswith("pypi:")
    body = F.when(pypi, F.substring(c, 6, 1 << 20)).when(c.startswith("npm:"), F.substring(c, 5, 1 << 20)).otherwise(c)
    pinned = pypi & body.contains("==")
    bare = F.regexp_replace(body, "^@+", "")
    name = F.when(pinned, F.substring_index(body, "==", 1)).otherwise(F.regexp_extract(body, "(?s)^(.*)@[^@]*$", 1))
    version = F.when(pinned, F.regexp_extract(body, "(?s)^.*?==(.*)$", 1)).otherwise(F.substring_index(body, "@", -1))
    return F.when(pinned | bare.contains("@"), F.struct(F.when(pypi, "pypi").otherwise("npm").alias("ecosystem"), name.alias("name"), version.alias("version")))


def public_ipv4(c: Column | str) -> Column:
    """Whether an IPv4 address is public: global and not multicast. Null if it is no IPv4 address."""
    c = col(c)
    part = [F.regexp_extract(c, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("int") for k in (1, 2, 3, 4)]
    n = ((part[0] * 256 + part[1]) * 256 + part[2]).cast("long") * 256 + part[3]
    inside = lambda net, bits: F.shiftright(n, 32 - bits) == (_address(net) >> (32 - bits))
    good = F.lit(False)
    for net, bits in (("192.0.0.9", 32), ("192.0.0.10", 32)):
        good = good | inside(net, bits)
    bad = F.lit(False)
    for net, bits in (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)):
        bad = bad | inside(net, bits)
    valid = (part[0] <= 255) & (part[1] <= 255) & (part[2] <= 255) & (part[3] <= 255)
    return F.when(valid, good | ~bad)


def public_address(c: Column | str) -> Column:
    """Whether an IPv4 or IPv6 address is public: global and not multicast; zone ids don't count, mapped IPv4 addresses count as themselves. Null if it is no address."""
    # a lambda, so that the address is taken out of its text once
    return F.get(F.transform(F.array(F.lower(F.substring_index(col(c), "%", 1))), _is_public), F.lit(0))


def _is_public(c: Column) -> Column:
    mapped = F.regexp_extract(c, r"^(?:0{0,4}:){2,5}ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    pair = [F.conv(F.regexp_extract(c, r"^(?:0{0,4}:){2,5}ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", k), 16, 10).cast("long") for k in (1, 2)]
    spelled = F.concat_ws(".", *((F.shiftright(p, s) % 256).cast("string") for p in pair for s in (8, 0)))
    group = [F.coalesce(F.conv(F.nullif(F.get(F.split(F.regexp_replace(c, "::.*$", ""), ":"), F.lit(k)), F.lit("")), 16, 10).cast("int"), F.lit(0)) for k in (0, 1, 2, 3)]
    a, b, d, e = group
    special = (a == 0x2001) & (((b == 1) & c.rlike("^2001:0*1::0*[12]$")) | (b == 3) | ((b == 4) & (d == 0x112)) | F.shiftright(b, 4).isin(2, 3))
    closed = (c.isin("::", "::1") | c.rlike("^(?:0+:){7}0*[01]$") | ((a == 0x64) & (b == 0xFF9B) & (d == 1)) | ((a == 0x100) & (b == 0) & (d == 0) & (e == 0)) | ((a == 0x2001) & ((b < 0x200) | (b == 0xDB8)) & ~special)
              | (a == 0x2002) | ((a == 0x3FFF) & (b < 0x1000)) | (F.shiftright(a, 9) == 0x7E) | (F.shiftright(a, 6) == 0x3FA) | (F.shiftright(a, 8) == 0xFF))
    six = c.rlike("^[0-9a-f:]*:[0-9a-f:]*$") & ~c.rlike(":::|::.*::|[0-9a-f]{5}") & (c.contains("::") | (F.size(F.split(c, ":")) == 8)) & (F.size(F.split(c, ":")) <= 9)
    return F.coalesce(public_ipv4(c), public_ipv4(mapped), F.when(six & pair[0].isNotNull(), public_ipv4(spelled)), F.when(six, ~closed))


def origin_form(url: Column | str) -> Column:
    """Path and query of an absolute URL, as a server is asked for them; "/" where there is none."""
    rest = F.regexp_extract(col(url), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)


def tail(c: Column | str, n: int = 2000) -> Column:
    """The last n characters of output, cleaned; the empty text where there was none."""
    whole = F.coalesce(col(c), F.lit(""))
    return sanitize(F.when(F.length(whole) > n, F.substring(whole, -n, n)).otherwise(whole))


def _address(dotted: str) -> int:
    out = 0
    for x in dotted.split("."):
        out = out * 256 + int(x)
    return out
