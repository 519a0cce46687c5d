"""Scalar functions as Column expressions; nothing here runs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming strips: ASCII, the Unicode separators, and the byte order mark.
_BLANK = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_EMPTY = "cast(array() as array<string>)"


def strip(value: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(value, f"^{_BLANK}+|{_BLANK}+$", "")


def normalise(value: Column) -> Column:
    """The form in which two signs are the same sign: stripped, lower case."""
    return F.lower(strip(value))


def collated(value: Column) -> Column:
    """A sort key in the order of the Unicode collation: accents and case matter only where letters are the same, small before capital."""
    return F.collate(value, "UNICODE")


def code_units(value: Column) -> Column:
    """A sort key in the order of UTF-16 code units, which puts characters beyond the basic plane before U+E000."""
    return F.encode(value, "UTF-16BE")


def lineage(*fields: Column) -> Column:
    """Lower-case text of several fields, blanks between; null fields are left out."""
    return F.lower(F.concat_ws(" ", *fields))


def contains_any(text: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """Whether ``text`` holds one of the terms anywhere, inside words too."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def cap(value: Column) -> Column:
    """A ceiling between 0 and 1; numbers above 1 count as percent, others than finite numbers as none."""
    sound = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(sound, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(value > 1, value / 100).otherwise(value))))


def band(ceiling: Column) -> Column:
    """Bands of confidence as 0 (low), 1 (moderate) and 2 (high)."""
    return F.when(ceiling >= 0.85, 2).when(ceiling >= 0.6, 1).otherwise(0)


BANDS = ("Low", "Moderate", "High")


def band_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(b) for b in BANDS]), (number + 1).cast("int"))


def hex_bits(value: Column) -> Column:
    """64 bits from 16 hexadecimal digits, an optional ``dhash64:`` before them; null for anything else."""
    digits = F.lower(F.regexp_replace(value, "^dhash64:", ""))
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("long")
    return F.when(F.regexp_like(digits, F.lit("^[0-9a-f]{16}$")), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def bits_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit words differ; null if either is null."""
    return F.bit_count(a.bitwiseXOR(b))


def dhash(pixels: Column) -> Column:
    """Difference hash of 72 values, eight rows of nine: a bit is set where a value is above its right neighbour, the first bit highest."""
    at = lambda k: (k - k % 8) / 8 * 9 + k % 8
    bit = lambda k: F.when(F.get(pixels, at(k).cast("int")) > F.get(pixels, at(k).cast("int") + 1), 1).otherwise(0).cast("long")
    folded = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda word, k: F.shiftleft(word, 1).bitwiseOR(bit(k)))
    return F.when(F.size(pixels) == 72, folded)


def image_kind(content: Column) -> Column:
    """jpg, png, gif, tif or webp by a file's first bytes; else null."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tif").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp"))


def url_extension(url: Column, content_type: Column) -> Column:
    """The file ending that a content type stands for, else that of the URL's path, else empty."""
    kind = F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1)))
    known = F.when(kind == "image/jpeg", ".jpg").when(kind == "image/png", ".png").when(kind == "image/webp", ".webp").when(kind == "image/gif", ".gif").when(kind == "image/tiff", ".tif")
    return F.coalesce(known, F.lower(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"(\.[A-Za-z0-9]+)$", 1)), F.lit(""))


def safe_id(value: Column) -> Column:
    """Runs of anything but letters, digits, dot, underscore and hyphen as one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")


def valid_url(url: Column) -> Column:
    return F.coalesce(F.regexp_like(url, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\s]+")) & F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull(), F.lit(False))


def moved_url(url: Column, old_host: str, new_host: str) -> Column:
    """The URL at another host where it is at ``old_host``."""
    return F.when(F.try_parse_url(url, F.lit("HOST")) == old_host, F.regexp_replace(url, F.lit("^([a-z]+://)[^/]+"), F.concat(F.lit("$1"), F.lit(new_host)))).otherwise(url)


def clean_list(values: Column, characters: int, most: int) -> Column:
    """Stripped, non-blank strings cut to so many characters, the first so many of them; null makes an empty list."""
    whole = F.coalesce(values, F.expr(_EMPTY))
    return F.slice(F.filter(F.transform(whole, lambda v: F.substring(strip(v), 1, characters)), lambda v: v.isNotNull() & (v != "")), 1, most)


def vocabulary(values: Column, characters: int = 220, most: int = 600) -> Column:
    """Distinct stripped entries of at most so many characters, in order, the first so many."""
    kept = F.filter(F.transform(F.coalesce(values, F.expr(_EMPTY)), strip), lambda v: v.isNotNull() & (v != "") & (F.length(v) <= characters))
    return F.slice(F.array_distinct(kept), 1, most)


def unfenced(text: Column) -> Column:
    """Text without a surrounding code fence."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", ""))


def only_in(values: Column, allowed: Column) -> Column:
    """The entries that are allowed, in order, as often as they are there."""
    return F.filter(values, lambda v: F.array_contains(allowed, v))


def not_in(values: Column, chosen: Column) -> Column:
    """The entries that are not chosen yet, in order, as often as they are there."""
    return F.filter(values, lambda v: ~F.array_contains(chosen, v))


def observation(text: Column, allowed: Column) -> Column:
    """A visual observation from JSON: confidence low, moderate or high (else low), a summary (else empty),
    and matched entries that are allowed, in order and once each."""
    raw = F.from_json(unfenced(text), "confidence string, summary string, matched array<string>")
    level = F.lower(raw["confidence"])
    matched = F.filter(F.array_distinct(F.coalesce(raw["matched"], F.expr(_EMPTY))), lambda v: F.array_contains(allowed, v))
    return F.struct(F.when(level.isin("low", "moderate", "high"), level).otherwise("low").alias("confidence"), F.coalesce(raw["summary"], F.lit("")).alias("summary"), matched.alias("matched"))


def source_key(doi: Column, url: Column, title: Column, organisation: Column) -> Column:
    """DOI, else URL, else title and organisation; empty strings count as missing."""
    full = lambda c: F.when(c != "", c)
    return F.coalesce(full(doi), full(url), F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(organisation, F.lit(""))))


def box_fits(box: Column, width: Column, height: Column) -> Column:
    """Whether [left, top, right, bottom] is a box with an area inside the image."""
    left, top, right, bottom = (F.get(box, F.lit(i)) for i in range(4))
    return F.coalesce((F.size(box) == 4) & (left >= 0) & (left < right) & (right <= width) & (top >= 0) & (top < bottom) & (bottom <= height), F.lit(False))


def safe_path(path: Column) -> Column:
    """Neither absolute nor with a step upwards."""
    return F.coalesce(~F.regexp_like(path, F.lit(r"^(/|\\|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)")), F.lit(False))


def model_name(value: Column) -> Column:
    return F.coalesce(F.regexp_like(value, F.lit("^[a-zA-Z0-9._-]{3,80}$")), F.lit(False))


def same_host(a: Column, b: Column) -> Column:
    """Equal host names, ports aside."""
    bare = lambda c: F.lower(F.regexp_replace(c, r":\d+$", ""))
    return F.coalesce(bare(a) == bare(b), F.lit(False))


def random_id(prefix: str) -> Column:
    """A new id in every row and every run."""
    return F.concat_ws("-", F.lit(prefix), F.unix_millis(F.current_timestamp()).cast("string"), F.substring(F.expr("uuid()"), 1, 6))


def frame_times(seconds: Column) -> Column:
    """Where to sample a clip: near the start, in the middle, near the end; two decimals, each once."""
    inside = lambda t: F.round(F.least(F.greatest(t, F.lit(0.0)), seconds), 2)
    return F.array_distinct(F.array(inside(F.least(F.lit(0.5), seconds * 0.1)), inside(seconds * 0.5), inside(seconds - 0.5)))
