"""Column functions of the item domain: bounds, colours, bit patterns, labels, versions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and hues that a hue is compared with.
HUES = [("red", 0), ("orange", 25), ("yellow", 55), ("green", 130), ("teal", 190), ("blue", 220), ("purple", 275), ("magenta", 320)]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(v: Column, low, high) -> Column:
    return F.greatest(_c(low), F.least(_c(high), v))


def half_up(v: Column, digits: int = 0) -> Column:
    """Round to nearest with halves toward plus infinity."""
    k = F.lit(float(10**digits))
    return F.floor(v * k + F.lit(0.5)) / k


def chebyshev(a: list[Column], b: list[Column]) -> Column:
    """Largest difference over channels."""
    gaps = [F.abs(x - y) for x, y in zip(a, b)]
    return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]


def chebyshev_arrays(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two arrays, added up in double."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two bit arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of packed words."""
    return F.aggregate(F.zip_with(a, b, hamming_packed), F.lit(0), lambda s, x: s + x.cast("int"))


def hamming_packed(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hue_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 360
    return F.least(d, F.lit(360) - d)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hsl(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue in degrees, saturation 0..1, lightness 0..100 of channels 0..255."""
    x = hsl_struct(r, g, b)
    return {k: x[k] for k in "hsl"}


def hsl_struct(r: Column, g: Column, b: Column) -> Column:
    def last(x: Column) -> Column:
        r, g, b, top, low, d = (x[k] for k in ("r", "g", "b", "top", "low", "d"))
        light = (top + low) / 2
        span = F.when(light > 0.5, F.lit(2.0) - top - low).otherwise(top + low)
        s = F.when(d == 0, 0.0).otherwise(d / F.when(span == 0, F.lit(1.0)).otherwise(span))
        safe = F.when(d == 0, F.lit(1.0)).otherwise(d)
        h = F.when(d == 0, 0.0).when(top == r, (g - b) / safe + F.when(g < b, 6.0).otherwise(0.0)).when(top == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4)
        return F.struct((h * 60).alias("h"), s.alias("s"), (light * 100).alias("l"))

    r, g, b = (x.cast("double") / 255 for x in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return let(F.struct(r.alias("r"), g.alias("g"), b.alias("b"), top.alias("top"), low.alias("low"), (top - low).alias("d")), last)


def colour_category(r: Column, g: Column, b: Column) -> Column:
    """Fixed colour families in order of their rules; null where hue decides."""
    def rules(x: Column) -> Column:
        h, s, light = x["h"], x["s"], x["l"]
        grey = s < F.when(h.between(195, 235), F.lit(0.22)).otherwise(F.lit(0.13))
        return (
            F.when((light < 15) & (spread < 30), "black")
            .when(light > 90, "white")
            .when(grey, F.when(light > 82, "white").when(light < 25, "black").otherwise("grey"))
            .when((h >= 18) & (h < 50) & (light >= 10) & (light <= 62) & (s < 0.65), "brown")
            .when((h >= 30) & (h < 46) & (light > 68) & (light <= 88), "brown")
        )

    spread = F.greatest(r, g, b) - F.least(r, g, b)
    return let(hsl_struct(r, g, b), rules)


def colour_sort_key(r: Column, g: Column, b: Column) -> Column:
    return let(hsl_struct(r, g, b), lambda x: F.when(x["s"] < 0.15, F.lit(400.0) + x["l"]).otherwise(x["h"]))


def hue_name(h: Column) -> Column:
    """Name of the nearest anchor, or of the two nearest ones in order of hue where none is within 18 degrees."""
    def name(ranked: Column) -> Column:
        one, two = ranked[0], ranked[1]
        low, high = F.when(one["i"] < two["i"], one).otherwise(two), F.when(one["i"] < two["i"], two).otherwise(one)
        wraps = (low["i"] == 0) & (high["i"] == len(HUES) - 1)
        pair = F.when(wraps, F.concat_ws("-", high["n"], low["n"])).otherwise(F.concat_ws("-", low["n"], high["n"]))
        return F.when(one["d"] <= 18, one["n"]).otherwise(pair)

    anchors = lambda x: F.array_sort(F.array(*[F.struct(hue_distance(x, F.lit(float(v))).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, v) in enumerate(HUES)]))
    return let(let(h, anchors), name)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def log_aspect(w: Column, h: Column) -> Column:
    return F.ln(w / F.nullif(h, F.lit(0)))


def parse_quantity(text: Column, most: int = 200) -> Column:
    """`12x` to 12; null unless digits remain that say 1..most."""
    digits = F.regexp_replace(text, "(?i)x+$", "")
    n = F.when(digits.rlike("^[0-9]+$"), digits.try_cast("bigint"))
    return F.when(n.between(1, most), n)


def page_summary(pages: Column, most: int = 8, total: Column | None = None) -> Column:
    """Up to `most` pages, else one fewer and how many more there are. With `total`, `pages` may be only the first `most` of them."""
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ", ")
    n = F.size(pages) if total is None else total
    return F.when(n <= most, text(pages)).otherwise(F.concat(text(F.slice(pages, 1, most - 1)), F.lit(" +"), (n - (most - 1)).cast("string")))


def newer_version(a: Column, b: Column) -> Column:
    """Whether dotted version a is above b; missing parts are 0."""
    parts = lambda v: F.transform(F.split(v, "\\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    n = F.greatest(F.size(parts(a)), F.size(parts(b)))
    pad = lambda v: F.concat(parts(v), F.array_repeat(F.lit(0), n - F.size(parts(v))))
    signs = F.filter(F.zip_with(pad(a), pad(b), lambda x, y: F.signum(x - y).cast("int")), lambda s: s != 0)
    return F.coalesce(F.try_element_at(signs, F.lit(1)), F.lit(0)) > 0


def time_ago(then: Column, now: Column) -> Column:
    """Age in whole seconds, minutes, hours, days (under 30), months (under 12) or years; empty for null."""
    s = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(then), F.lit(0))
    say = lambda k, unit: F.concat(F.floor(s / k).cast("string"), F.lit(unit))
    return F.when(then.isNull(), "").when(s < 60, say(1, " s")).when(s < 3600, say(60, " min")).when(s < 86400, say(3600, " h")).when(s < 30 * 86400, say(86400, " d")).when(s < 360 * 86400, say(30 * 86400, " mo")).otherwise(say(360 * 86400, " y"))


def plural(n: Column, one: Column, few: Column, many: Column) -> Column:
    """Three-form plural."""
    a, b = n % 10, n % 100
    return F.when((a == 1) & (b != 11), one).when(a.between(2, 4) & ~b.between(12, 14), few).otherwise(many)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def file_key(name: Column, size: Column) -> Column:
    return F.concat_ws("::", name, size.cast("string"))


def session_name(file: Column, first: Column, last: Column) -> Column:
    return F.concat(F.regexp_replace(file, "(?i)\\.pdf$", ""), F.lit(" ("), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")"))


def session_id() -> Column:
    """A random (version 4) id; one for each row and each run."""
    return F.expr("uuid()")


def quoted(text: Column) -> Column:
    """Text as part of an address: a space is %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def unquoted(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("%20"), F.lit("+")))


def progress(step: Column, total: Column) -> Column:
    return F.floor((step + 1) / F.nullif(total, F.lit(0)) * 100 + 0.5)


def size_label(a: Column, b: Column) -> Column:
    return F.concat(F.greatest(a, b).cast("string"), F.lit("×"), F.least(a, b).cast("string"))


def bits_from_hex(text: Column, n: int) -> Column:
    """The first n bits of a hex string, most significant first."""
    digits = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.lpad(F.conv(F.substring(text, i, F.lit(1)), 16, 2), 4, "0"))
    every = F.array_join(digits, "")
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substring(every, i, F.lit(1)).cast("int"))


def hex_from_bits(bits: Column) -> Column:
    """Bits padded with zeros at the end to whole hex digits, in lower case."""
    pad = F.concat(bits, F.array_repeat(F.lit(0), F.pmod(-F.size(bits), F.lit(4))))
    nibble = lambda i: F.lower(F.conv(F.array_join(F.transform(F.slice(pad, i * 4 + 1, F.lit(4)), lambda b: b.cast("string")), ""), 2, 16))
    return F.array_join(F.transform(F.sequence(F.lit(0), (F.size(pad) / 4 - 1).cast("int")), nibble), "")


def upper_median(values: Column) -> Column:
    """Of a sorted array, the entry at half its size."""
    return F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def cramer(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> tuple[Column, Column]:
    """x and y of a x + b y = e, c x + d y = f; null where there is no single answer."""
    det = F.nullif(a * d - b * c, F.lit(0))
    return (e * d - b * f) / det, (a * f - e * c) / det
