"""Column functions over numbers, times and text rows."""

from pyspark.sql import functions as F

from pathledger.functions.paths import _col

NETWORK_TAG = "NETWORK"


def guarded_int(text):
    """Digits-only text as BIGINT; anything else, and values past BIGINT, give 0."""
    text = _col(text)
    number = F.when(text.rlike("^[0-9]+\\z"), text.try_cast("bigint"))
    return F.coalesce(number, F.lit(0).cast("bigint"))


def epoch_seconds(seconds):
    """Timestamp of epoch seconds, whole or fractional."""
    return F.timestamp_seconds(_col(seconds))


def epoch_nanos(nanos):
    """Timestamp of epoch nanoseconds, cut to microseconds."""
    micros = F.floor(_col(nanos) / F.lit(1000).cast("decimal(10,0)")).cast("bigint")
    return F.timestamp_micros(micros)


def checkpoint_row(path, size, modified):
    """One pipe-delimited checkpoint line."""
    size = F.coalesce(_col(size).cast("string"), F.lit("0"))
    modified = F.coalesce(_col(modified).cast("string"), F.lit("0"))
    return F.concat_ws("|", _col(path), size, modified, F.lit(NETWORK_TAG))


def progress_pct(processed, total):
    """Share done in percent with one decimal; 0 without a total."""
    share = F.lit(100.0) * _col(processed) / F.nullif(_col(total), F.lit(0))
    return F.coalesce(F.round(share, 1), F.lit(0.0))


def rate(count, elapsed):
    """Count per second; 0 when no time has passed."""
    per_second = _col(count) / F.nullif(_col(elapsed).cast("double"), F.lit(0.0))
    return F.coalesce(per_second, F.lit(0.0))


def runtime_hms(seconds):
    """``HH:MM:SS`` of a number of seconds; the hours may pass 24."""
    whole = _col(seconds).cast("bigint")
    hours = F.floor(whole / 3600)
    minutes = F.floor(F.pmod(whole, F.lit(3600)) / 60)
    return F.format_string("%02d:%02d:%02d", hours, minutes, F.pmod(whole, F.lit(60)))
