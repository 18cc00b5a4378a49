"""Scalar functions: digests, splits, buckets, rates, text normalisers, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_BYTE = b"\x00"

# The white space that text stripping removes, as a Java character class.
WHITESPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The line separators that end a line of a text body.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Split borders in basis points of the bucket range.
SPLIT_BORDERS = (("train", 8000), ("dev", 9000), ("calibration", 9500), ("sealed", 10000))
SPLITS = ("train", "dev", "calibration", "sealed")
HELD_OUT_SPLITS = ("dev", "calibration", "sealed")

REQUEST_SALT = "split.request.v1"
TRAJECTORY_SALT = "split.trajectory.v1"
GROUP_SALT = "source-group.v1"
SCOPE = "00000000-0000-4000-8000-00000000abcd"

WILSON_Z = 1.959963984540054


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sha256_text(text) -> Column:
    return F.sha2(F.encode(_col(text), "utf-8"), 256)


def salted(salt: str, *binary: Column) -> Column:
    """SHA-256 of salt, a zero byte and the given binary columns."""
    return F.sha2(F.concat(F.encode(F.lit(salt), "utf-8"), F.lit(ZERO_BYTE), *binary), 256)


def content_digest(request, response) -> Column:
    """SHA-256 of request bytes, a zero byte and response bytes."""
    return F.sha2(F.concat(_col(request), F.lit(ZERO_BYTE), _col(response)), 256)


def uuid_bytes(uuid) -> Column:
    return F.unhex(F.regexp_replace(_col(uuid), "-", ""))


def source_group_kind(trajectory) -> Column:
    return F.when(_col(trajectory).isNull(), "request").otherwise("trajectory")


def source_group_digest(request_sha256, trajectory, scope: str = SCOPE, salt: str = GROUP_SALT) -> Column:
    """The trajectory inside its scope when there is one, the request otherwise."""
    tagged = salted(salt, uuid_bytes(F.lit(scope)), uuid_bytes(trajectory))
    return F.when(_col(trajectory).isNull(), _col(request_sha256)).otherwise(tagged)


def hex_prefix_number(digest, digits: int) -> Column:
    """The first hex digits of a digest as an unsigned number."""
    number = F.conv(F.substring(_col(digest), 1, digits), 16, 10)
    return number.cast("decimal(20,0)") if digits > 15 else number.cast("bigint")


def split_bucket(group_sha256, kind, request_salt: str = REQUEST_SALT, trajectory_salt: str = TRAJECTORY_SALT) -> Column:
    """Bucket 0..9999 from two digest bytes. The two kinds of group use different salts."""
    source = F.unhex(_col(group_sha256))
    digest = F.when(_col(kind) == "request", salted(request_salt, source)).otherwise(salted(trajectory_salt, source))
    return hex_prefix_number(digest, 4) % 10_000


def split_of_bucket(bucket) -> Column:
    chain = None
    for name, border in SPLIT_BORDERS[:-1]:
        test = _col(bucket) < border
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise(SPLIT_BORDERS[-1][0])


def split_of_group(group_sha256, kind, **salts) -> Column:
    return split_of_bucket(split_bucket(group_sha256, kind, **salts))


def split_rank(split) -> Column:
    """Position of a held-out split in the total order of cases."""
    return F.array_position(F.array(*[F.lit(name) for name in HELD_OUT_SPLITS]), _col(split)).cast("int") - 1


def name_uuid(namespace: str, name) -> Column:
    """Name-based UUID, version 5."""
    digest = F.sha1(F.concat(uuid_bytes(F.lit(namespace)), F.encode(_col(name), "utf-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def order_digest(salt: str, *parts) -> Column:
    """Hash that fixes a pseudo-random but repeatable row order."""
    return sha256_text(F.concat(F.lit(salt), *[_col(part) for part in parts]))


def case_id(uuid, ordinal) -> Column:
    return F.sha2(F.concat(F.encode(_col(uuid), "utf-8"), F.lit(ZERO_BYTE), F.encode(_col(ordinal).cast("string"), "utf-8")), 256)


def hash_choice(digest, options) -> Column:
    """One of a fixed list of options, chosen by the first 64 bits of a digest."""
    index = (hex_prefix_number(digest, 16) % len(options)).cast("int")
    return F.element_at(F.array(*[F.lit(option) for option in options]), index + 1)


def power_of_two_bucket(value) -> Column:
    """Smallest power of two that is not below the value; 0 stays 0."""
    v = _col(value).cast("bigint")
    above_one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(v - 1)))
    return F.when(v <= 1, v).otherwise(above_one)


def rate_bps(numerator, denominator) -> Column:
    """Half-up basis points, 0 for an empty denominator and never above 10000."""
    n, d = _col(numerator).cast("bigint"), _col(denominator).cast("bigint")
    return F.when(d <= 0, F.lit(0).cast("bigint")).otherwise(
        F.least(F.lit(10_000).cast("bigint"), int_div(n * 10_000 + int_div(d, F.lit(2)), d))
    )


def int_div(left, right) -> Column:
    """Integer division; operands here are never negative."""
    return F.call_function("div", _col(left), _col(right))


def _wilson(successes, total, sign: int) -> Column:
    n, s = _col(total).cast("double"), _col(successes).cast("double")
    z = F.lit(WILSON_Z)
    p = s / n
    denominator = F.lit(1.0) + z * z / n
    centre = (p + z * z / (F.lit(2.0) * n)) / denominator
    margin = z * F.sqrt(p * (F.lit(1.0) - p) / n + z * z / (F.lit(4.0) * n * n)) / denominator
    bound = F.greatest(centre - margin, F.lit(0.0)) if sign < 0 else F.least(centre + margin, F.lit(1.0))
    return F.when(n <= 0, F.lit(0).cast("bigint")).otherwise(F.floor(bound * 10_000 + 0.5))


def wilson_lower_bps(successes, total) -> Column:
    """Lower end of the 95 % Wilson interval in basis points."""
    return _wilson(successes, total, -1)


def wilson_upper_bps(successes, total) -> Column:
    """Upper end of the 95 % Wilson interval in basis points."""
    return _wilson(successes, total, 1)


def strip(text) -> Column:
    """Strip Unicode white space on both ends."""
    return F.regexp_replace(_col(text), f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def ascii_tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]+"), F.lit(0))


def normalise_ascii(text) -> Column:
    """Lower-cased ASCII words joined by one space."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", " "))


def normalise_unicode(text) -> Column:
    """Letters and digits of any script, lower-cased after the test, one space between words."""
    return F.trim(F.lower(F.regexp_replace(_col(text), r"[^\p{L}\p{N}]+", " ")))


def unicode_tokens(text) -> Column:
    return F.filter(F.split(normalise_unicode(text), " "), lambda token: token != "")


def parse_utc(text) -> Column:
    """Strict UTC timestamp text (Z or +00:00, at most nine fraction digits); anything else is NULL."""
    t = _col(text)
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,9})?(?:Z|\+00:00)$"
    seconds = F.substring(t, 1, 19)
    fraction = F.rpad(F.regexp_extract(t, r"\.([0-9]{1,6})", 1), 6, "0")
    return F.when(
        t.rlike(shape) & ~t.rlike(r"T24:|[\r\n]") & ~t.startswith("0000"),
        F.try_to_timestamp(F.concat(seconds, F.lit("."), fraction, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSX")),
    )


def utf8_prefix(text, size) -> Column:
    """At most `size` bytes of the text; a character cut in half is dropped."""
    return _drop_cut(F.substring(F.encode(_col(text), "utf-8"), F.lit(1), _number(size)))


def utf8_suffix(text, size) -> Column:
    raw = F.encode(_col(text), "utf-8")
    length = F.octet_length(raw)
    start = F.greatest(F.lit(1), length - _number(size) + 1)
    return _drop_cut(F.substring(raw, start, _number(size)))


def _number(value) -> Column:
    return F.lit(value) if isinstance(value, int) else value


def _drop_cut(raw: Column) -> Column:
    """Decode after removing continuation bytes at the front and an unfinished character at the end."""
    as_hex = F.hex(raw)
    front = F.regexp_replace(as_hex, "^(?:[89AB][0-9A-F])+", "")
    unfinished = "(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){0,2})$"
    return F.decode(F.unhex(F.regexp_replace(front, unfinished, "")), "utf-8")


def status_class(status) -> Column:
    return F.concat(F.call_function("div", _col(status), F.lit(100)).cast("string"), F.lit("xx"))


def throughput_milli(tokens, total_ms) -> Column:
    """Tokens per second in thousandths over the whole call; NULL when unknown."""
    t, ms = _col(tokens), _col(total_ms)
    return F.when(t.isNotNull() & (ms > 0), F.call_function("div", t * 1_000_000, ms))


def outcome_class(refusal, model_completed, success, finish_reasons) -> Column:
    """First that applies: refusal, incomplete, finish reasons, success, upstream failure."""
    reasons = _col(finish_reasons)
    return (
        F.when(_col(refusal), "refusal")
        .when(~_col(model_completed) & _col(success), "incomplete")
        .when(F.length(reasons) > 0, reasons)
        .when(_col(success), "success")
        .otherwise("upstream_failure")
    )


def language_code(label) -> Column:
    """Keep plain language codes, `mixed` and `unknown`; all else becomes `unknown`."""
    text = _col(label)
    return F.when(text.rlike(r"^(?:[a-z]{2,3}(?:-[A-Za-z]{2,4})?|mixed|unknown)$"), text).otherwise("unknown")


def percent_text(bps) -> Column:
    """Basis points as a percentage, two decimals only where they carry something."""
    value = _col(bps)
    plain = F.format_string("%.0f%%", value / 100.0)
    return F.when(value.isNull(), "not recorded").when(value % 100 == 0, plain).otherwise(F.format_string("%.2f%%", value / 100.0))


def duration_text(ms) -> Column:
    """Seconds from one second on (one decimal unless whole), milliseconds below."""
    value = _col(ms)
    seconds = F.when(value % 1000 == 0, F.format_string("%.0fs", value / 1000.0)).otherwise(F.format_string("%.1fs", value / 1000.0))
    return F.when(value >= 1000, seconds).otherwise(F.concat(value.cast("string"), F.lit("ms")))


def canonical_text(**fields: Column) -> Column:
    """Canonical JSON of a known set of fields: sorted names, compact, nulls kept, closed by a newline."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.concat(F.to_json(ordered, {"ignoreNullFields": "false"}), F.lit("\n"))


def canonical_digest(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON of a known set of fields."""
    return sha256_text(canonical_text(**fields))
