"""Column functions: number parsing, slugs, text clean-up, formatting, time and money arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
# The address of an online document.
DOC_ADDRESS = r"https?://docs\.google\.com/document/(?:u/\d+/)?d/([A-Za-z0-9_-]+)"
DOC_URL = f"(?i){DOC_ADDRESS}"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    """A string as a double; null for null, blank, words, suffixes and NaN. One that is too large is infinite."""
    return F.when(text.rlike(_NUMBER), F.trim(text)).try_cast("double")


def finite(value: Column) -> Column:
    """A double; null for infinities."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def finite_number(text: Column) -> Column:
    """A string as a finite double; null for null, blank, words, suffixes, NaN and infinities."""
    return finite(number(text))


def slugify(text: Column) -> Column:
    """Lower case; each run of other than a-z and 0-9 becomes one dash; none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def slug_or(text: Column, fallback: Column) -> Column:
    """The slug, or the fallback where it is empty."""
    return F.coalesce(F.nullif(slugify(text), F.lit("")), fallback)


def doc_id(url: Column) -> Column:
    """The document id in a link to an online document, null for other links."""
    return F.nullif(F.regexp_extract(url, DOC_URL, 1), F.lit(""))


def collapse_space(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_escape(text: Column) -> Column:
    """The five characters with a meaning in HTML; ampersands first."""
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals and no grouping."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value.cast("double")))


def fmt_usd(value: Column, digits: int = 2) -> Column:
    """Dollars with grouped thousands, the sign first; a dash for null."""
    body = F.concat(F.when(value < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(value.cast("double")), digits))
    return F.coalesce(body, F.lit("—"))


def fmt_pct(value: Column, digits: int = 2) -> Column:
    """A signed percentage; a dash for null."""
    return F.coalesce(F.concat(F.when(value >= 0, "+").otherwise(""), fixed(value, digits), F.lit("%")), F.lit("—"))


def fmt_bps(value: Column, digits: int = 2) -> Column:
    """Basis points; a dash for null."""
    return F.coalesce(F.concat(fixed(value, digits), F.lit(" bps")), F.lit("—"))


def short_address(address: Column) -> Column:
    """First six and last four characters of an address."""
    return F.concat(F.left(address, F.lit(6)), F.lit("…"), F.right(address, F.lit(4)))


def hex_text(data: Column) -> Column:
    """Bytes, such as an address, as lower-case hexadecimal digits after 0x; null for null."""
    return F.concat(F.lit("0x"), F.lower(F.hex(data)))


def countdown(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS, not below zero."""
    seconds = F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("long")
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", part(F.floor(seconds / 3600)), part(F.pmod(F.floor(seconds / 60), F.lit(60))), part(F.pmod(seconds, F.lit(60))))


def iso_ms(ms: Column) -> Column:
    """Epoch milliseconds as an ISO-8601 instant (the session's time zone must be UTC)."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def floor_hour(ms: Column) -> Column:
    """Epoch milliseconds down to the hour."""
    return ms - F.pmod(ms, F.lit(HOUR_MS))


def long_date(ts: Column) -> Column:
    """A date as "January 2, 2024"."""
    return F.date_format(ts, "MMMM d, yyyy")


def percent_change(last: Column, first: Column) -> Column:
    """100 * (last / first - 1); null where first is not above zero."""
    return F.when(first > 0, (last / first - 1) * 100)


def spread_bps(bid: Column, ask: Column) -> Column:
    """Spread over mid price in basis points; null unless 0 < bid < ask."""
    return F.when((bid > 0) & (ask > bid), (ask - bid) / ((ask + bid) / 2) * 10_000)


# The types of images that pages hold, and their extensions.
IMAGE_TYPES = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/svg+xml": ".svg"}
IMAGE_EXTENSIONS = {"png": ".png", "jpg": ".jpg", "jpeg": ".jpg", "gif": ".gif", "svg": ".svg"}


def media_extension(mime: Column, url: Column | None = None) -> Column:
    """File extension of an image's media type; of another type that of its address, if one is given and it is an image's, else ``.bin``."""
    out = F.lit(".bin")
    if url is not None:
        own = F.lower(F.regexp_extract(url, r"[^/]\.([^./]*)$", 1))
        for said, extension in IMAGE_EXTENSIONS.items():
            out = F.when(own == said, extension).otherwise(out)
    for kind, extension in IMAGE_TYPES.items():
        out = F.when(mime == kind, extension).otherwise(out)
    return out


def content_name(data: Column, extension: Column | None = None) -> Column:
    """A file name from content: 16 hex digits of SHA-256, then the extension."""
    name = F.left(F.sha2(data, 256), F.lit(16))
    return name if extension is None else F.concat(name, extension)


def decode_base64(text: Column) -> Column:
    """Bytes of base64 text, null if it is malformed."""
    return F.try_to_binary(text, F.lit("base64"))


def not_finite(number: Column) -> Column:
    """Whether a number is missing, not a number, or infinite."""
    x = number.cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
